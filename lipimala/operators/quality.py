"""Agreement of converted text with OCR and with proofread text."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lipimala.functions.glyphs import edit_distance, error_rate
from lipimala.functions.telugu import comparable, comparable_word
from lipimala.operators.transcode import OPEN

_SUMS = ("words", "matched", "disagreements", "unresolved", "agreeing_confidence", "disagreeing_confidence")


def disagrees(converted: Column, ocr: Column) -> Column:
    """Whether a reading exists and is another text."""
    return F.coalesce(comparable(ocr) != comparable(converted), F.lit(False))


def page_quality(comparisons: DataFrame, page: list[str], converted: str = "converted", ocr: str = "ocr", confidence: str = "confidence") -> DataFrame:
    """Additive measures per page. A word counts as matched where it has a reading and a confidence."""
    matched = F.col(ocr).isNotNull() & F.col(confidence).isNotNull()
    differs = matched & disagrees(F.col(converted), F.col(ocr))
    return comparisons.groupBy(*page).agg(
        F.count("*").alias("words"),
        F.count_if(matched).alias("matched"),
        F.count_if(differs).alias("disagreements"),
        F.count_if(F.contains(F.col(converted), F.lit(OPEN))).alias("unresolved"),
        F.coalesce(F.sum(F.when(matched & ~differs, F.col(confidence))), F.lit(0.0)).alias("agreeing_confidence"),
        F.coalesce(F.sum(F.when(differs, F.col(confidence))), F.lit(0.0)).alias("disagreeing_confidence"),
    )


def rates(measures: DataFrame) -> DataFrame:
    """Derived figures: agreement is 1 where nothing matched, mean confidences 0 where there is none."""
    agreeing = F.col("matched") - F.col("disagreements")
    return (
        measures.withColumn("unmatched", F.col("words") - F.col("matched"))
        .withColumn("agreements", agreeing)
        .withColumn("agreement_rate", F.coalesce(F.try_divide(agreeing, F.col("matched")), F.lit(1.0)))
        .withColumn("mean_confidence_agreeing", F.coalesce(F.try_divide(F.col("agreeing_confidence"), agreeing), F.lit(0.0)))
        .withColumn("mean_confidence_disagreeing", F.coalesce(F.try_divide(F.col("disagreeing_confidence"), F.col("disagreements")), F.lit(0.0)))
    )


def with_total(measures: DataFrame, book: list[str], page: str = "page") -> DataFrame:
    """Pages and, as page 0, their sum per book; rates are to be derived after."""
    sums = [F.sum(c).alias(c) for c in _SUMS]
    total = measures.groupingSets([[F.col(c) for c in [*book, page]], [F.col(c) for c in book]], *(F.col(c) for c in [*book, page])).agg(*sums)
    return total.withColumn(page, F.coalesce(page, F.lit(0)))


def rounded_row(quality: DataFrame) -> DataFrame:
    """Report figures: rates to 4 digits, confidences to 1, half to even."""
    return quality.withColumn("agreement_rate", F.bround("agreement_rate", 4)).withColumn("mean_confidence_agreeing", F.bround("mean_confidence_agreeing", 1)).withColumn("mean_confidence_disagreeing", F.bround("mean_confidence_disagreeing", 1))


def percent(rate: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", rate * 100)


# --- confusions --------------------------------------------------------------------------------------


def replacements(read: str, meant: str) -> list[tuple[str, str]]:
    """What stands for what, by the longest matching blocks of the two comparable texts; insertions and
    losses are no confusion."""
    a, b = comparable_word(read), comparable_word(meant)
    return [(a[i:j], b[k:m]) for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b, False).get_opcodes() if tag == "replace"]


def _confusions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(*pair, n) for read, meant, n in zip(*(c.to_pylist() for c in batch.columns), strict=True) for pair in replacements(read, meant)]
        columns = [list(c) for c in zip(*out, strict=True)] or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["ocr", "converted", "n"])


def confusions(comparisons: DataFrame, converted: str = "converted", ocr: str = "ocr") -> DataFrame:
    """(ocr, converted, count): equal pairs of words are counted first, and the blocks of each are matched once."""
    pairs = comparisons.where(disagrees(F.col(converted), F.col(ocr))).groupBy(F.col(ocr).alias("o"), F.col(converted).alias("c")).agg(F.count("*").alias("n"))
    return pairs.mapInArrow(_confusions, "ocr string, converted string, n bigint").groupBy("ocr", "converted").agg(F.sum("n").alias("count"))


# --- proofread text ----------------------------------------------------------------------------------


def words(text: Column) -> Column:
    """The words of a comparable text; none for an empty one."""
    trimmed = F.trim(F.regexp_replace(comparable(text), r"(?U)\s+", " "))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, " "))


def ground_truth(pages: DataFrame, reference: str, converted: str, ocr: str) -> DataFrame:
    """Adds word errors, word and character error rates of the conversion and the OCR against ``reference``."""
    out = pages.withColumn("_r", words(F.col(reference)))
    for name, source in (("converted", converted), ("ocr", ocr)):
        out = out.withColumn(f"_{name}", words(F.col(source)))
        out = out.withColumn(f"{name}_word_errors", edit_distance(F.col("_r"), F.col(f"_{name}")))
        text, truth = F.array_join(f"_{name}", " "), F.array_join("_r", " ")
        out = out.withColumn(f"{name}_wer", error_rate(F.col(f"{name}_word_errors"), F.size("_r"))).withColumn(f"{name}_cer", error_rate(F.levenshtein(truth, text), F.length(truth)))
    return out.withColumn("reference_words", F.size("_r")).drop("_r", "_converted", "_ocr")


def overall(truth: DataFrame) -> DataFrame:
    """Errors of all pages by words of all pages."""
    sums = truth.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("reference_words", "converted_word_errors", "ocr_word_errors")))
    return sums.withColumn("converted_wer", error_rate(F.col("converted_word_errors"), F.col("reference_words"))).withColumn("ocr_wer", error_rate(F.col("ocr_word_errors"), F.col("reference_words")))


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            old, new = (a or "").split(), (b or "").split()
            out += [(" ".join(old[i:j]), " ".join(new[k:m])) for tag, i, j, k, m in difflib.SequenceMatcher(None, old, new, False).get_opcodes() if tag != "equal"]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.string())], names=["before", "after"])


def page_changes(pages: DataFrame, before: str, after: str) -> DataFrame:
    """Adds before_words and the word and character error rates of ``after`` against ``before``, page by page.

    Texts are compared as words, blanks of any kind between them; a null text has none.
    """
    old, new = (words(F.coalesce(F.col(c), F.lit(""))) for c in (before, after))
    both = pages.withColumn("_a", old).withColumn("_b", new)
    letters = lambda c: F.array_join(c, "")
    rated = both.withColumn("before_words", F.size("_a")).withColumn("word_error_rate", error_rate(edit_distance(F.col("_a"), F.col("_b")), F.size("_a")))
    return rated.withColumn("character_error_rate", error_rate(F.levenshtein(letters("_a"), letters("_b")), F.length(letters("_a")))).drop("_a", "_b")


def word_changes(pages: DataFrame, before: str, after: str) -> DataFrame:
    """(before, after, count) of all word changes between two outputs of the same pages."""
    rows = pages.where(~F.col(before).eqNullSafe(F.col(after))).select(before, after)
    return rows.mapInArrow(_changes, "before string, after string").groupBy("before", "after").agg(F.count("*").alias("count"))
