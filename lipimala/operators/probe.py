"""Measures of a font: percentiles by occurrence, ink extents, glyph assignment by likeness."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lipimala.functions.bitmaps import GRID

#: What is added to a percentile before it becomes a font measure.
SLACK = 0.05


def percentile(values: DataFrame, by: list[str], value: str, share: float, weight: str | None = None) -> DataFrame:
    """(``by``, percentile): the value at place int(share * n), from 0, of the n sorted values, the last at most.

    With ``weight`` a value counts as often as it says. Runs over distinct values with their cumulated
    weights; no group is collected.
    """
    w = Window.partitionBy(*by).orderBy(value)
    each = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    cumulated = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("_n").over(Window.partitionBy(*by))
    at = F.least(F.col("_t") - 1, F.floor(F.lit(share) * F.col("_t")))
    return each.withColumn("_c", cumulated).withColumn("_t", total).where(F.col("_c") > at).groupBy(*by).agg(F.min(value).alias("percentile"))


def font_measure(found: DataFrame) -> DataFrame:
    return found.withColumn("measure", F.round(F.col("percentile") + SLACK, 2))


def ink_extents(shapes: DataFrame, ident: str, grid: str = "grid") -> DataFrame:
    """(``ident``, top, bottom, left, right): first and last inked row and column of a grid, as shares of its
    side; shapes without ink are left out."""
    kind = shapes.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unpackbits(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, GRID * GRID // 8), axis=1).reshape(-1, GRID, GRID)
            rows, columns = bits.any(2), bits.any(1)
            ok = rows.any(1)
            ends = [rows.argmax(1), GRID - rows[:, ::-1].argmax(1), columns.argmax(1), GRID - columns[:, ::-1].argmax(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), *(pa.array(e[ok] / GRID) for e in ends)], names=["ident", "top", "bottom", "left", "right"])

    rows = shapes.where(F.length(grid) == GRID * GRID // 8).select(F.col(ident).alias("ident"), grid)
    return rows.mapInArrow(run, f"ident {kind}, top double, bottom double, left double, right double").withColumnRenamed("ident", ident)


def assign(cost: np.ndarray) -> np.ndarray:
    """The column of each row in a least-cost assignment (rows no more than columns), by augmenting paths."""
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = ~used[1:]
            reduced = cost[i0 - 1] - u[i0] - v[1:]
            better = free & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = j0
            j1 = int(np.where(free, least[1:], np.inf).argmin()) + 1
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[1:][free] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = np.full(n, -1)
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def likeness(glyphs: DataFrame, targets: DataFrame, font: str = "font") -> DataFrame:
    """(``font``, glyph, target, score): mean overlap of the bitmaps (glyph, font, grid) of one font with those of
    (target, font, grid) of the same. A font has some 200 of either, so its pairs are few."""
    pairs = glyphs.join(targets.withColumnRenamed("grid", "other"), font).select(font, "glyph", "target", "grid", "other")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(font, "glyph", "target").schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (3, 4))
            both, joint = (np.bitwise_count(x).sum(1, dtype=np.int64) for x in (a & b, a | b))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.where(joint > 0, both / np.maximum(joint, 1), 0.0))], names=[*batch.schema.names[:3], "score"])

    return pairs.mapInArrow(run, f"{kinds}, score double").groupBy(font, "glyph", "target").agg(F.avg("score").alias("score"))


def assign_glyphs(scores: DataFrame, font: str = "font", *, sure: float = 0.8, likely: float = 0.6, margin: float = 0.1) -> DataFrame:
    """(``font``, glyph, target, score, margin, status) of the best assignment of every font's glyphs to its codes.

    margin is the lead over the glyph's next best target. status: sure, likely or doubtful by score and
    margin, duplicate where another target scores higher but went to another glyph. A font's square of some
    200 glyphs is solved in one task, and fonts are solved side by side.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scores.select(font, "glyph", "target").schema.fields)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        square = rows.pivot(index="glyph", columns="target", values="score").fillna(0.0).sort_index().sort_index(axis=1)
        table = square.to_numpy()
        turned = len(table) > table.shape[1]
        chosen = assign(-(table.T if turned else table))
        i, j = np.arange(len(chosen)), np.asarray(chosen, int)
        i, j = (j, i) if turned else (i, j)
        score = table[i, j]
        rest = np.where(np.arange(table.shape[1]) == j[:, None], -np.inf, table[i]).max(1) if table.shape[1] > 1 else np.zeros(len(i))
        lead = score - rest
        status = np.select([lead < 0, (score >= sure) & (lead >= margin), score >= likely], ["duplicate", "sure", "likely"], "doubtful")
        found = pd.DataFrame({"glyph": square.index[i], "target": square.columns[j], "score": score, "margin": lead, "status": status})
        found.insert(0, font, rows[font].iloc[0])
        return found.sort_values("glyph")

    return scores.groupBy(font).applyInPandas(solve, f"{kinds}, score double, margin double, status string")
