"""Incremental forms of batch operators as structured streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lipimala.functions.glyphs import characters
from lipimala.operators.transcode import Mapping, gap_length, glyph_count, render, with_segments

KEY = ["book", "page", "line", "word", "position"]


def first_deliveries(stream: DataFrame, key: list[str] = KEY, at: str = "indexed_at", within: str = "30 days") -> DataFrame:
    """A stream without repeated deliveries; a key is remembered for ``within`` of event time, which bounds
    the state. Later repeats are for the batch that compacts the table."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, within).dropDuplicatesWithinWatermark(key)


def shape_counts(stream: DataFrame, window: str = "1 day", at: str = "indexed_at") -> DataFrame:
    """Occurrences per shape and day of indexing, final when the watermark has passed the day."""
    return first_deliveries(stream, at=at).where("shape_id is not null").groupBy(F.window(at, window).alias("window"), "book", "shape_id").agg(F.count("*").alias("n"))


def converted(stream: DataFrame, glyphs: str, mapping: Mapping) -> DataFrame:
    """Words of a stream with text, glyphs and unmapped: the batch transcoding without state."""
    parts = with_segments(stream, glyphs, mapping)
    return parts.withColumn("text", render(F.col("segments"))).withColumn("glyph_count", glyph_count(F.col("segments"))).withColumn("unmapped", gap_length(F.col("segments"))).drop("segments")


def glyph_usage(stream: DataFrame, glyphs: str) -> DataFrame:
    """Running count of every glyph."""
    return stream.select(F.explode(characters(F.col(glyphs))).alias("glyph")).groupBy("glyph").agg(F.count("*").alias("count"))


def resumable(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Micro-batches through ``step``, which may keep tables of its own (learning, indexing). The checkpoint
    resumes after the last batch done; a step must give the same result when its batch is run again."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True)
