"""Glyphs to lines, words, runs and units: grouping that depends on order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lipimala.functions.glyphs import BASELINE_TOLERANCE, ZERO_WIDTH


def baseline_rows(pieces: DataFrame, page: list[str], baseline: str, order: list[str], tolerance: float = BASELINE_TOLERANCE) -> DataFrame:
    """Adds ``row``, from 1: pieces of a page whose baseline is within ``tolerance`` of the row's first one.

    The distance is to the first member, not to the one before, so a slow drift starts new rows. A fold
    over the page's sorted baselines carries that anchor; a page is a bounded group.
    """
    sorted_pieces = F.array_sort(F.collect_list(F.struct(F.col(baseline).alias("b"), *order)))
    start = F.struct(F.lit(0).alias("row"), F.lit(None).cast("double").alias("anchor"), F.array().cast("array<int>").alias("rows"))

    def step(state: Column, piece: Column) -> Column:
        fresh = state["anchor"].isNull() | (piece["b"] - state["anchor"] > tolerance)
        row = state["row"] + fresh.cast("int")
        return F.struct(row.alias("row"), F.when(fresh, piece["b"]).otherwise(state["anchor"]).cast("double").alias("anchor"), F.concat(state["rows"], F.array(row)).alias("rows"))

    paged = pieces.groupBy(*page).agg(sorted_pieces.alias("p")).withColumn("rows", F.aggregate("p", start, step, lambda s: s["rows"]))
    placed = paged.select(*page, F.explode(F.arrays_zip("p", "rows")).alias("z")).select(*page, *(F.col(f"z.p.{c}").alias(c) for c in order), F.col("z.rows").alias("row"))
    return pieces.join(placed, [*page, *order])


def joined_rows(glyphs: DataFrame, page: list[str], piece: list[str], *, baseline: str = "baseline", left: str = "left", order: str = "glyph_no", tolerance: float = BASELINE_TOLERANCE) -> DataFrame:
    """Glyphs in reading order: adds ``row`` and ``pos``, both from 1, and a blank between the pieces of a row.

    A piece is what ``piece`` tells apart on a page, with one ``baseline`` and ``left`` edge. Pieces of a row go
    from left to right. The blank is no legacy glyph and has the box of the glyph it stands before.
    """
    pieces = glyphs.groupBy(*page, *piece).agg(F.first(baseline).alias("_baseline"), F.first(left).alias("_left"))
    placed = baseline_rows(pieces, page, "_baseline", piece, tolerance)
    nth = F.row_number().over(Window.partitionBy(*page, "row").orderBy("_left", "_baseline", *piece))
    placed = placed.select(*page, *piece, "row", nth.alias("_nth"))
    rows = glyphs.join(placed, [*page, *piece])
    w = Window.partitionBy(*page, "row")
    first = F.row_number().over(Window.partitionBy(*page, "row", "_nth").orderBy(order)) == 1
    rows = rows.withColumn("_blanks", F.when(first & (F.col("_nth") > 1), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False))))
    rows = rows.withColumn("_blank", F.explode("_blanks"))
    rows = rows.withColumn("char", F.when(F.col("_blank"), " ").otherwise(F.col("char"))).withColumn("is_legacy", F.col("is_legacy") & ~F.col("_blank"))
    return rows.withColumn("pos", F.row_number().over(w.orderBy("_nth", order, F.desc("_blank")))).drop("_blanks", "_blank", "_nth")


def islands(rows: DataFrame, line: list[str], order: str, keep: Column, name: str) -> DataFrame:
    """The rows where ``keep`` holds, with ``name``: the number, from 1, of the unbroken run they are in."""
    w = Window.partitionBy(*line).orderBy(order)
    marked = rows.withColumn("_keep", F.coalesce(keep, F.lit(False)))
    begins = (F.col("_keep") & ~F.coalesce(F.lag("_keep").over(w), F.lit(False))).cast("int")
    running = F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_begins", begins).withColumn(name, running.cast("int")).where("_keep").drop("_keep", "_begins")


def split_words(glyphs: DataFrame, line: list[str], order: str = "pos", char: str = "char", legacy: str = "is_legacy") -> DataFrame:
    """Glyphs of words with ``word``: longest runs of legacy glyphs that are no blanks."""
    return islands(glyphs, line, order, F.col(legacy) & (F.col(char) != " "), "word")


def script_runs(glyphs: DataFrame, line: list[str], order: str = "pos", legacy: str = "is_legacy") -> DataFrame:
    """Adds ``run``, from 1: consecutive glyphs with the same flag; blanks of legacy fonts stay in theirs."""
    w = Window.partitionBy(*line).orderBy(order)
    change = (F.lag(legacy).over(w).isNull() | (F.lag(legacy).over(w) != F.col(legacy))).cast("int")
    return glyphs.withColumn("_c", change).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_c")


def units(glyphs: DataFrame, word: list[str], order: str = "pos", width: str = "width", zero: float = ZERO_WIDTH) -> DataFrame:
    """Adds ``unit``, from 1: a glyph narrower than ``zero`` belongs to the unit before it."""
    w = Window.partitionBy(*word).orderBy(order)
    begins = ((F.col(width) >= zero) | (F.row_number().over(w) == 1)).cast("int")
    return glyphs.withColumn("_b", begins).withColumn("unit", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_b")


def joined(char: str, order: str) -> Column:
    """The characters of a group in order, as one string."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, char))), lambda x: x[char]), "")


def outer_box(box: str) -> Column:
    """The box around a group's boxes."""
    return F.struct(F.min(f"{box}.x0").alias("x0"), F.min(f"{box}.y0").alias("y0"), F.max(f"{box}.x1").alias("x1"), F.max(f"{box}.y1").alias("y1"))


def words_of(glyphs: DataFrame, line: list[str], order: str = "pos") -> DataFrame:
    """One row per word: text, units and outer box, from glyphs (char, is_legacy, width, box)."""
    parts = units(split_words(glyphs, line, order), [*line, "word"], order)
    by_unit = parts.groupBy(*line, "word", "unit").agg(joined("char", order).alias("text"), outer_box("box").alias("box"))
    return by_unit.groupBy(*line, "word").agg(joined("text", "unit").alias("text"), F.transform(F.array_sort(F.collect_list(F.struct("unit", "text"))), lambda x: x["text"]).alias("units"), outer_box("box").alias("box"))


def scan_words(occurrences: DataFrame, page: list[str]) -> DataFrame:
    """One row per scanned word with its shape ids in drawing order and its box."""
    w = F.transform(F.array_sort(F.collect_list(F.struct("position", "shape_id"))), lambda x: x["shape_id"])
    return occurrences.groupBy(*page, "line", "word").agg(w.alias("shape_ids"), outer_box("bbox").alias("box"))
