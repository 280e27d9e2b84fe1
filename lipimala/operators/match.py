"""Spatial matching of words with OCR words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lipimala.functions.glyphs import iou
from lipimala.functions.telugu import is_telugu_word

# Least overlap for measuring and for learning.
MEASURE_OVERLAP, LEARN_OVERLAP = 0.3, 0.5
#: Side of the grid cells in which boxes of a page meet, in the boxes' unit.
CELL = 64.0


def _cells(rows: DataFrame, box: str, cell: float) -> DataFrame:
    """One row per grid cell the box touches: a cell takes a word or two, a box as large as its page some hundred."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(f"{box}.{lo}") / cell), F.floor(F.greatest(F.col(f"{box}.{hi}"), F.col(f"{box}.{lo}")) / cell))
    return rows.withColumn("_cx", F.explode(span("x0", "x1"))).withColumn("_cy", F.explode(span("y0", "y1")))


def best_matches(words: DataFrame, ocr: DataFrame, page: list[str], word: list[str], order: str, *, box: str = "box", ocr_box: str = "ocr_box", least: float = MEASURE_OVERLAP, cell: float = CELL) -> DataFrame:
    """Inner matches: for every word the OCR word of highest overlap, the first in ``order`` among equals,
    if its overlap (shared by joint area) is ``least`` or more. One OCR word may match many words.

    Boxes meet only in the grid cells of their page that both touch, so a page's pairs are never all made;
    a pair counts in the first cell both share. Null boxes match nothing.
    """
    left = _cells(words.where(F.col(box).isNotNull()), box, cell)
    right = _cells(ocr.where(F.col(ocr_box).isNotNull()), ocr_box, cell)
    pairs = left.join(right, [*page, "_cx", "_cy"])
    first = (F.col("_cx") == F.floor(F.greatest(F.col(f"{box}.x0"), F.col(f"{ocr_box}.x0")) / cell)) & (F.col("_cy") == F.floor(F.greatest(F.col(f"{box}.y0"), F.col(f"{ocr_box}.y0")) / cell))
    scored = pairs.where(first).drop("_cx", "_cy").withColumn("overlap", iou(F.col(box), F.col(ocr_box))).where(F.col("overlap") > 0)
    rank = F.row_number().over(Window.partitionBy(*page, *word).orderBy(F.desc("overlap"), order))
    return scored.withColumn("_rank", rank).where((F.col("_rank") == 1) & (F.col("overlap") >= least)).drop("_rank")


def compare_words(words: DataFrame, ocr: DataFrame, page: list[str], word: list[str], order: str, **options) -> DataFrame:
    """All words with their OCR word's columns, null where none matches."""
    extra = [c for c in ocr.columns if c not in page]
    found = best_matches(words, ocr, page, word, order, **options).select(*page, *word, *extra, "overlap")
    return words.join(found, [*page, *word], "left")


def observations(words: DataFrame, ocr: DataFrame, page: list[str], word: list[str], order: str, *, text: str = "ocr_text", **options) -> DataFrame:
    """Matches to learn from: the best match must be a Telugu word, else the word is left out; the next best
    is no substitute."""
    return best_matches(words, ocr, page, word, order, **({"least": LEARN_OVERLAP} | options)).where(is_telugu_word(F.col(text)))
