"""Greedy longest-match transcoding through a mapping table.

At each place the longest key that fits is taken, a blank stands for itself, and characters no key covers
gather into one gap. The keys of a mapping of checked size are compiled into one expression whose branches
share their beginnings, so a text is segmented in the JVM by one scan without a shuffle. A larger mapping is
joined instead: every text offers its substrings to the table.
"""

from __future__ import annotations

import json
import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lipimala.functions.telugu import finish

# The marks around an unmapped gap.
OPEN, CLOSE = "⟦", "⟧"
#: Keys up to which a mapping is compiled into an expression and a literal map.
COMPILED = 20_000


def trie_pattern(keys: list[str]) -> str:
    """A pattern for the longest of ``keys`` at a place, with shared beginnings written once."""
    root: dict = {}
    for key in keys:
        node = root
        for c in key:
            node = node.setdefault(c, {})
        node[""] = {}

    def write(node: dict) -> str:
        ends = "" in node
        branches = [_escaped(c) + write(child) for c, child in sorted(node.items()) if c]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and not ends else f"(?:{'|'.join(branches)})"
        return f"{body}?" if ends else body

    return write(root)


def _escaped(char: str) -> str:
    return "\\" + char if re.match(r"[^\w\s]", char) and ord(char) < 128 else char


class Mapping:
    """A mapping of checked size, ready for use in expressions."""

    def __init__(self, table: DataFrame, glyphs: str = "glyphs", unicode: str = "unicode", *, limit: int = COMPILED) -> None:
        """Reads the table: null texts count as empty, which silences the glyphs; null and empty keys map nothing."""
        rows = table.where(F.col(glyphs) != "").groupBy(glyphs).agg(F.max(F.coalesce(F.col(unicode), F.lit(""))).alias("u")).limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"more than {limit} keys: use segments_by_join")
        self.entries = {r[0]: r[1] for r in rows} | {" ": " "}
        self.pattern = trie_pattern(list(self.entries))

    def lookup(self, token: Column) -> Column:
        """A token's text, or null for a gap.

        The entries are one constant, an array of small maps by checksum: a map is searched from its start,
        so one map of all entries would cost every token thousands of comparisons.
        """
        slots = max(1, len(self.entries) // 4)
        parts: list[dict[str, str]] = [{} for _ in range(slots)]
        for key, value in self.entries.items():
            parts[zlib.crc32(key.encode()) % slots][key] = value
        table = F.from_json(F.lit(json.dumps(parts)), F.lit("array<map<string,string>>"))
        return F.element_at(F.get(table, (F.crc32(token) % slots).cast("int")), token)


def tokens(text: Column, mapping: Mapping) -> Column:
    """The keys and gaps of a text in order; they join to the text again."""
    return F.regexp_extract_all(text, F.lit(f"(?s){mapping.pattern}|(?:(?!{mapping.pattern}).)+"), F.lit(0))


def with_segments(rows: DataFrame, text: str, mapping: Mapping, name: str = "segments") -> DataFrame:
    """Adds ``name``, array<struct<glyphs, unicode>>; unicode is null for a gap. A null text has null segments."""
    parts = F.transform(tokens(F.col(text), mapping), lambda t: F.struct(t.alias("glyphs"), mapping.lookup(t).alias("unicode")))
    return rows.withColumn(name, parts)


def gaps(segments: Column) -> Column:
    return F.transform(F.filter(segments, lambda s: s["unicode"].isNull()), lambda s: s["glyphs"])


def glyph_count(segments: Column) -> Column:
    """Characters of all segments but blanks."""
    return F.aggregate(F.filter(segments, lambda s: s["glyphs"] != " "), F.lit(0).cast("bigint"), lambda n, s: n + F.length(s["glyphs"]))


def gap_length(segments: Column) -> Column:
    return F.aggregate(gaps(segments), F.lit(0).cast("bigint"), lambda n, g: n + F.length(g))


def raw_text(segments: Column) -> Column:
    shown = F.transform(segments, lambda s: F.coalesce(s["unicode"], F.concat(F.lit(OPEN), s["glyphs"], F.lit(CLOSE))))
    return F.array_join(shown, "")


def render(segments: Column) -> Column:
    """The text of segments in reading order, gaps between marks."""
    return finish(raw_text(segments))


def coverage_ratio(unmapped: Column, glyphs: Column) -> Column:
    """Share of mapped characters, 1 where there are none."""
    return F.when(glyphs > 0, 1 - unmapped / glyphs).otherwise(1.0)


def coverage(rows: DataFrame, segments: str, by: list[str]) -> DataFrame:
    """glyphs, unmapped and ratio per group."""
    sums = rows.groupBy(*by).agg(F.coalesce(F.sum(glyph_count(F.col(segments))), F.lit(0)).alias("glyphs"), F.coalesce(F.sum(gap_length(F.col(segments))), F.lit(0)).alias("unmapped"))
    return sums.withColumn("ratio", coverage_ratio(F.col("unmapped"), F.col("glyphs")))


def unmapped_report(rows: DataFrame, segments: str) -> DataFrame:
    """(glyphs, count) of every gap, most frequent first."""
    return rows.select(F.explode(gaps(F.col(segments))).alias("glyphs")).groupBy("glyphs").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "glyphs")


def convert_runs(runs: DataFrame, line: list[str], mapping: Mapping) -> DataFrame:
    """(``line``, text): legacy runs transcoded, others as they are, joined in order. Runs: run, text, is_legacy."""
    done = with_segments(runs, "text", mapping).withColumn("shown", F.when(F.col("is_legacy"), render(F.col("segments"))).otherwise(F.col("text")))
    return done.groupBy(*line).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "shown"))), lambda x: x["shown"]), "").alias("text"))


def pages_of(lines: DataFrame, page: list[str], order: str = "line_no", text: str = "text") -> DataFrame:
    """(``page``, text): the page's lines in order, one below the other."""
    return lines.groupBy(*page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n").alias("text"))


def segments_by_join(rows: DataFrame, ident: str, text: str, table: DataFrame, glyphs: str = "glyphs", unicode: str = "unicode") -> DataFrame:
    """(``ident``, segments) for mappings beyond ``COMPILED`` keys: substrings meet the table in a shuffled join.

    Every distinct text is segmented once. Only substrings of lengths that keys have are offered, the longest key
    included, with a digest in the text's place. A fold over a text's matches then walks it greedily. A null text
    has null segments. No side is broadcast, so that nothing but the keys' lengths passes through the driver.
    """
    lengths = [r[0] for r in table.where(F.length(glyphs) > 0).select(F.length(glyphs)).union(table.sparkSession.sql("SELECT 1")).distinct().collect()]
    texts = rows.where(F.length(text) > 0).select(text).distinct().withColumn("_digest", F.sha2(F.col(text), 256))
    begin = F.explode(F.sequence(F.lit(1), F.length(text)))
    spans = texts.select("_digest", text, begin.alias("at")).withColumn("n", F.explode(F.array(*map(F.lit, sorted(lengths))))).where(F.col("n") <= F.length(text) - F.col("at") + 1)
    offered = spans.select("_digest", "at", "n", F.substring(F.col(text), F.col("at"), F.col("n")).alias("_key"))
    blank = rows.sparkSession.createDataFrame([(" ", " ")], "_key string, _u string")
    known = table.where(F.col(glyphs).isNotNull() & ~F.col(glyphs).isin("", " ")).groupBy(F.col(glyphs).alias("_key")).agg(F.max(F.coalesce(F.col(unicode), F.lit(""))).alias("_u")).unionByName(blank)
    best = offered.join(known.hint("shuffle_merge"), "_key").groupBy("_digest", "at").agg(F.max_by(F.struct("n", "_u"), "n").alias("hit"))
    hits = best.groupBy("_digest").agg(F.map_from_entries(F.collect_list(F.struct("at", "hit"))).alias("hits"))
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<glyphs:string,unicode:string>>").alias("out"))

    def step(state: Column, at: Column) -> Column:
        hit = F.element_at(F.col("hits"), at)
        char = F.substring(F.col(text), at, F.lit(1))
        last = F.get(state["out"], F.size(state["out"]) - 1)
        grown = F.concat(F.slice(state["out"], 1, F.greatest(F.size(state["out"]) - 1, F.lit(0))), F.array(F.struct(F.concat(last["glyphs"], char).alias("glyphs"), F.lit(None).cast("string").alias("unicode"))))
        fresh = F.concat(state["out"], F.array(F.struct(char.alias("glyphs"), F.lit(None).cast("string").alias("unicode"))))
        gap = F.when((F.size(state["out"]) > 0) & last["unicode"].isNull(), grown).otherwise(fresh)
        key = F.concat(state["out"], F.array(F.struct(F.substring(F.col(text), at, hit["n"]).alias("glyphs"), hit["_u"].alias("unicode"))))
        moved = F.when(at < state["next"], state["out"]).when(hit.isNotNull(), key).otherwise(gap)
        return F.struct(F.when(at < state["next"], state["next"]).when(hit.isNotNull(), at + hit["n"]).otherwise(at + 1).alias("next"), moved.alias("out"))

    walked = F.aggregate(F.sequence(F.lit(1), F.length(text)), start, step, lambda s: s["out"])
    found = texts.join(hits.hint("shuffle_merge"), "_digest").select(F.col(text).alias("_walked"), walked.alias("_found"))
    none = F.array().cast("array<struct<glyphs:string,unicode:string>>")
    gap = F.array(F.struct(F.col(text).alias("glyphs"), F.lit(None).cast("string").alias("unicode")))
    segments = F.when(F.length(text) > 0, F.coalesce("_found", gap)).when(F.length(text) == 0, none)
    return rows.select(ident, text).join(found.hint("shuffle_merge"), F.col(text) == F.col("_walked"), "left").select(ident, segments.alias("segments"))


# --- scanned text ------------------------------------------------------------------------------------


def scan_transcode(words: DataFrame, names: DataFrame, word: list[str]) -> DataFrame:
    """Words of shape ids as text: (``word``, text, unmapped array<bigint>, glyphs), by a join with (shape_id, unicode).

    ``word`` names the columns that tell words apart. A shape without a name shows as ⟦#id⟧; neighbouring
    ones share their marks.
    """
    each = words.select(*word, F.posexplode("shape_ids").alias("pos", "shape_id")).join(names, "shape_id", "left")
    known = F.transform(F.array_sort(F.collect_list(F.struct("pos", "shape_id", "unicode"))), lambda x: F.coalesce(x["unicode"], F.concat(F.lit(OPEN + "#"), x["shape_id"].cast("string"), F.lit(CLOSE))))
    missing = F.array_sort(F.collect_list(F.when(F.col("unicode").isNull(), F.col("shape_id"))))
    texts = each.groupBy(*word).agg(F.replace(F.array_join(known, ""), F.lit(CLOSE + OPEN), F.lit("")).alias("raw"), missing.alias("unmapped"), F.count("*").alias("glyphs"))
    return texts.withColumn("text", finish(F.col("raw"))).drop("raw")


def unmapped_ids(texts: DataFrame) -> DataFrame:
    """(shape_id, count) of shapes without a name."""
    return texts.select(F.explode("unmapped").alias("shape_id")).groupBy("shape_id").agg(F.count("*").alias("count"))
