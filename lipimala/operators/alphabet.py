"""Statistics of glyphs and shapes: rankings, coverage, growth, samples, readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lipimala.functions.glyphs import ZERO_WIDTH, characters

# Examples kept per glyph, share of occurrences an alphabet is to cover, members kept per shape.
EXAMPLES, COVERAGE, MEMBERS = 8, 0.99, 16


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark stops ranking a group at k before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def shape_ranking(occurrences: DataFrame, by: list[str], order: list[str], least: int = 1) -> DataFrame:
    """(``by``, shape_id, count, band): count and the band seen last, for shapes of ``least`` occurrences."""
    ranked = occurrences.where("shape_id is not null").groupBy(*by, "shape_id").agg(F.count("*").alias("count"), F.max_by("band", F.struct(*order)).alias("band"))
    return ranked.where(F.col("count") >= least)


def alphabet_stats(counts: DataFrame, by: list[str], count: str = "count", share: float = COVERAGE) -> DataFrame:
    """Shapes in use, singletons, how many of the most frequent reach ``share``, and all occurrences.

    The cumulated sum runs over the distinct counts of a group, of which there are few, not over its shapes.
    """
    used = counts.where(F.col(count) > 0).groupBy(*by, F.col(count).alias("c")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("c"))
    before = F.coalesce(F.sum(F.col("c") * F.col("n")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(F.col("c") * F.col("n")).over(Window.partitionBy(*by))
    steps = used.withColumn("_before", before).withColumn("_total", total)
    # of n shapes with c occurrences each, those whose cumulated sum stays below the share
    below = F.greatest(F.lit(0), F.least(F.col("n"), F.ceil((F.col("_total") * share - F.col("_before")) / F.col("c")) - 1))
    return steps.groupBy(*by).agg(
        F.sum("n").alias("shapes"),
        F.coalesce(F.sum(F.when(F.col("c") == 1, F.col("n"))), F.lit(0)).alias("singletons"),
        (F.sum(below) + 1).alias("shapes_for_coverage"),
        F.max("_total").alias("occurrences"),
    )


def growth(occurrences: DataFrame, book: list[str], page: str = "page") -> DataFrame:
    """(``book``, page, new_shapes): shapes seen first on the page, 0 where there is none."""
    first = occurrences.where("shape_id is not null").groupBy(*book, "shape_id").agg(F.min(page).alias(page)).groupBy(*book, page).agg(F.count("*").alias("new_shapes"))
    return occurrences.select(*book, page).distinct().join(first, [*book, page], "left").fillna(0, ["new_shapes"])


def systematic_sample(rows: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """``k`` rows spread evenly from a group's first to its last, or all of a smaller group."""
    w = Window.partitionBy(*by)
    at = F.row_number().over(w.orderBy(*order)) - 1
    n = F.count("*").over(w)
    step = (F.col("_n") - 1) / (k - 1) if k > 1 else F.lit(0.0)
    wanted = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * step + F.lit(1e-9)).cast("int")))
    picked = rows.withColumn("_at", at).withColumn("_n", n)
    return picked.where((F.col("_n") <= k) | F.array_contains(wanted, F.col("_at"))).drop("_at", "_n")


def member_sample(rows: DataFrame, by: list[str], key: list[str], k: int = MEMBERS, seed: int = 0) -> DataFrame:
    """``k`` members per group, each as likely as any other and the same in every run."""
    return top_k(rows, by, [F.xxhash64(*key, F.lit(seed)), *map(F.col, key)], k).drop("rank")


def majority(readings: DataFrame, by: list[str], reading: str, order: str) -> DataFrame:
    """(``by``, proposal, votes): the most frequent reading that is not empty, the first seen among equals."""
    votes = readings.where(F.col(reading) != "").groupBy(*by, reading).agg(F.count("*").alias("votes"), F.min(order).alias("_first"))
    best = top_k(votes, by, [F.desc("votes"), F.col("_first")], 1)
    named = readings.select(*by).distinct().join(best.select(*by, F.col(reading).alias("proposal"), "votes"), by, "left")
    return named.fillna("", ["proposal"]).fillna(0, ["votes"])


def glyph_stats(words: DataFrame, by: list[str], glyphs: str = "glyphs", order: str = "seq", examples: int = EXAMPLES) -> DataFrame:
    """(``by``, glyph, count, words): occurrences of each glyph and the words it is in most often, the shorter
    and then the first seen among equals. Words are counted before their characters are spread."""
    distinct = words.where(F.col(glyphs) != "").groupBy(*by, glyphs).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    each = distinct.select(*by, glyphs, "n", "first", F.explode(characters(F.col(glyphs))).alias("glyph"))
    per_word = each.groupBy(*by, "glyph", glyphs, "n", "first").agg((F.count("*") * F.col("n")).alias("count"))
    counts = per_word.groupBy(*by, "glyph").agg(F.sum("count").alias("count"))
    best = top_k(per_word, [*by, "glyph"], [F.desc("n"), F.length(glyphs), F.col("first")], examples)
    lists = best.groupBy(*by, "glyph").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", glyphs))), lambda x: x[glyphs]).alias("words"))
    return counts.join(lists, [*by, "glyph"])


def unit_examples(words: DataFrame, by: list[str], units: str = "units", order: str = "seq", examples: int = EXAMPLES) -> DataFrame:
    """(``by``, glyph, units): the units of several glyphs that a glyph is in most often, the shorter and then the
    first seen among equals. A glyph counts once in a unit; null units have none."""
    each = words.select(*by, order, F.posexplode(units).alias("at", "unit")).where(F.length("unit") > 1)
    counted = each.groupBy(*by, "unit").agg(F.count("*").alias("n"), F.min(F.struct(order, "at")).alias("first"))
    spread = counted.withColumn("glyph", F.explode(F.array_distinct(characters(F.col("unit")))))
    best = top_k(spread, [*by, "glyph"], [F.desc("n"), F.length("unit"), F.col("first")], examples)
    return best.groupBy(*by, "glyph").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "unit"))), lambda x: x["unit"]).alias("units"))


def zero_width(glyphs: DataFrame, by: list[str], width: str = "width") -> DataFrame:
    """(``by``, glyph, count, zero, zero_width): narrow in more than half of all cases."""
    narrow = F.count_if(F.col(width) < ZERO_WIDTH)
    return glyphs.groupBy(*by, "glyph").agg(F.count("*").alias("count"), narrow.alias("zero")).withColumn("zero_width", 2 * F.col("zero") > F.col("count"))


def atlas_rows(occurrences: DataFrame, readings: DataFrame, same: DataFrame, excluded: DataFrame, book: list[str], least: int = 1) -> DataFrame:
    """Rows of the atlas: count, band, majority reading and like shapes of every shape not excluded."""
    kept = occurrences.join(excluded, "shape_id", "left_anti")
    ranked = shape_ranking(kept, book, ["page", "line", "word", "position"], least)
    named = ranked.join(majority(readings, [*book, "shape_id"], "reading", "seq"), [*book, "shape_id"], "left")
    return named.join(same, "shape_id", "left").fillna("", ["proposal"]).fillna(0, ["votes"])
