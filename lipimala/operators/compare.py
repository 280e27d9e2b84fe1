"""Two mappings compared word by word, with OCR readings as votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lipimala.functions.glyphs import characters
from lipimala.functions.telugu import comparable
from lipimala.operators.transcode import OPEN, Mapping, render, with_segments
from lipimala.runtime import small

# The verdicts in the order of a report.
VERDICTS = ("new_wrong", "candidate_gap", "human", "old_wrong")


def convert_both(words: DataFrame, glyphs: str, candidate: Mapping, reference: Mapping) -> DataFrame:
    """Adds candidate and reference, the word's text by either mapping."""
    new = with_segments(words, glyphs, candidate, "_new").withColumn("candidate", render(F.col("_new"))).drop("_new")
    return with_segments(new, glyphs, reference, "_old").withColumn("reference", render(F.col("_old"))).drop("_old")


def verdict(candidate: Column, candidate_votes: Column, reference_votes: Column) -> Column:
    return (
        F.when(F.contains(candidate, F.lit(OPEN)), "candidate_gap")
        .when((candidate_votes > 0) & (reference_votes == 0), "old_wrong")
        .when((reference_votes > 0) & (candidate_votes == 0), "new_wrong")
        .otherwise("human")
    )


def differences(converted: DataFrame, glyphs: str, ocr: str, first: Column) -> DataFrame:
    """Words whose two texts differ, grouped by glyphs and texts: count, votes of the readings for either
    text (no reading is no vote), the least ``first`` and the verdict."""
    reading = comparable(F.col(ocr))
    vote = lambda c: F.count_if(F.coalesce(reading == comparable(F.col(c)), F.lit(False)))
    grouped = (
        converted.where(F.col("candidate") != F.col("reference"))
        .groupBy(F.col(glyphs).alias("glyphs"), "candidate", "reference")
        .agg(F.count("*").alias("count"), vote("candidate").alias("candidate_votes"), vote("reference").alias("reference_votes"), F.min(first).alias("first"))
    )
    return grouped.withColumn("verdict", verdict(F.col("candidate"), F.col("candidate_votes"), F.col("reference_votes")))


def report_order(found: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict"))
    return found.orderBy(rank, F.desc("count"), "glyphs")


def summary(found: DataFrame) -> DataFrame:
    """(verdict, groups, words) of all four verdicts, also those without a group."""
    names = found.sparkSession.createDataFrame([(v,) for v in VERDICTS], "verdict string")
    sums = found.groupBy("verdict").agg(F.count("*").alias("groups"), F.sum("count").alias("words"))
    return names.join(sums, "verdict", "left").fillna(0, ["groups", "words"])


#: Names up to which a font's list travels as one map.
NAMES = 70_000


def shape_names(rows: DataFrame, glyphs: str, names: DataFrame, name: str = "shapes", *, limit: int = NAMES) -> DataFrame:
    """Adds the names of a sequence's glyphs by blanks, ``?`` for one without; ``names`` (glyph, name) is a
    font's own list, one row per glyph. Up to ``limit`` names travel as one map; beyond that the characters
    of the distinct sequences are joined with them. Without any name the text is empty; a null sequence has none."""
    if small(names, limit):
        table = F.broadcast(names.agg(F.map_from_entries(F.collect_list(F.struct("glyph", "name"))).alias("_names")))
        shown = F.array_join(F.transform(characters(F.col(glyphs)), lambda c: F.coalesce(F.element_at("_names", c), F.lit("?"))), " ")
        return rows.join(table).withColumn(name, F.when(F.cardinality("_names") > 0, shown).otherwise("")).drop("_names")
    distinct = rows.select(F.col(glyphs).alias("_glyphs")).where("_glyphs <> ''").distinct()
    each = distinct.select("_glyphs", F.posexplode(characters(F.col("_glyphs"))).alias("_at", "glyph")).join(names.select("glyph", "name"), "glyph", "left")
    spelled = each.groupBy("_glyphs").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("name", F.lit("?")).alias("n")))), lambda x: x["n"]), " ").alias(name))
    joined = rows.join(spelled, F.col(glyphs) == F.col("_glyphs"), "left").drop("_glyphs")
    return joined.withColumn(name, F.when(F.col(glyphs) == "", "").otherwise(F.col(name)))
