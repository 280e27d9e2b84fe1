"""Shapes and the catalog: gated neighbours, leader clustering, ambiguity, page ranking."""

from __future__ import annotations

import copy
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lipimala.functions.bitmaps import CANVAS, GRID, THICK_BLOB, grown, holes, stray_share, thick_alike, thick_blob, thick_blobs, to_canvas, to_grid, unpacked
from lipimala.runtime import maybe_broadcast, pick

# Nearest shapes looked at when assigning and when looking for like ones, and their distances.
CANDIDATES, WIDE, WIDE_STRAY = 8, 16, 0.35
#: Largest distance and log differences of height and aspect within a shape.
DISTANCE, HEIGHT, ASPECT = 0.1, 0.1, 0.1
#: Steps of height and of aspect that one task compares, and the bytes of bitmaps.
TILE, GRID_BYTES, CANVAS_BYTES = 3, GRID * GRID // 8, CANVAS[0] * CANVAS[1] // 8


def features(parts: DataFrame, ident: list[str], body: str = "body") -> DataFrame:
    """grid, canvas, height, aspect, holes of components (mask, x0, y0, x1, y1, body)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.select(*ident).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                high, wide = row["y1"] - row["y0"], row["x1"] - row["x0"]
                mask = unpacked(row["mask"], (high, wide))
                out.append({**{k: row[k] for k in ident}, "grid": np.packbits(to_grid(mask)).tobytes(), "canvas": np.packbits(to_canvas(mask, row[body])).tobytes(), "height": high / row[body], "aspect": wide / high, "holes": holes(mask, 0.005 * row[body] ** 2)})
            kinds = [*(batch.schema.field(k) for k in ident), pa.field("grid", pa.binary()), pa.field("canvas", pa.binary()), pa.field("height", pa.float64()), pa.field("aspect", pa.float64()), pa.field("holes", pa.int32())]
            yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))

    return parts.select(*ident, "mask", "x0", "y0", "x1", "y1", body).mapInArrow(run, f"{schema}, grid binary, canvas binary, height double, aspect double, holes int")


def _tiles(shapes: DataFrame, around: bool) -> DataFrame:
    """Rows in the tile of their band, holes, height and aspect, where each asks; ``around`` adds the tiles of like measures."""
    h, a = (F.floor(F.log(F.abs(F.col(c))) / limit) for c, limit in (("height", HEIGHT), ("aspect", ASPECT)))
    steps = (-1, 1) if around else (0,)
    tiles = F.array(*(F.xxhash64("band", "holes", F.floor((h + i) / TILE), F.floor((a + j) / TILE)) for i in steps for j in steps))
    own = F.xxhash64("band", "holes", F.floor(h / TILE), F.floor(a / TILE))
    return shapes.select("*", own.alias("own"), F.explode(F.array_distinct(tiles)).alias("tile")).withColumn("asks", F.col("tile") == F.col("own")).drop("own")


def _usable(shapes: DataFrame) -> DataFrame:
    return shapes.where((F.length("grid") == GRID * GRID // 8) & (F.col("grid") != F.unhex(F.lit("00" * (GRID * GRID // 8)))) & F.col("height").isNotNull() & F.col("aspect").isNotNull() & F.col("holes").isNotNull() & F.col("band").isNotNull())


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grid and canvas in one, compressed; a canvas of another size is left out."""
    for batch in batches:
        bits = [zlib.compress(g + c if c is not None and len(c) == CANVAS_BYTES else g, 1) for g, c in zip(batch["grid"].to_pylist(), batch["canvas"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bits, pa.binary())], names=["shape_id", "band", "holes", "height", "aspect", "bits"])


class _Side:
    """Shapes of a tile in numpy; forms are the distinct ones among their measures and grids."""

    def __init__(self, table: pa.Table, codes: dict, thick: bool) -> None:
        self.ids = table["shape_id"].to_numpy()
        grids = np.zeros((len(table), GRID_BYTES), np.uint8)
        if thick:
            self.held, self.canvas = np.zeros(len(table), bool), np.zeros((len(table), CANVAS_BYTES), np.uint8)
        for i, x in enumerate(table["bits"]):
            bits = np.frombuffer(zlib.decompress(x.as_py()) if thick else x.as_py(), np.uint8)
            grids[i] = bits[:GRID_BYTES]
            if len(bits) > GRID_BYTES:
                self.held[i], self.canvas[i] = True, bits[GRID_BYTES:]
        code = np.array([codes.setdefault(x, len(codes)) for x in zip(table["band"].to_pylist(), table["holes"].to_pylist(), strict=True)], np.int64)
        measures = np.stack([table["height"].to_numpy(), table["aspect"].to_numpy(), code.astype(float)], 1)
        key = np.concatenate([grids, np.ascontiguousarray(measures).view(np.uint8)], 1)
        _, first, which = np.unique(np.ascontiguousarray(key).view(f"V{key.shape[1]}").ravel(), return_index=True, return_inverse=True)
        self.rows = np.lexsort((self.ids, which))  # a form's rows lie together, the least id first
        self.start = np.searchsorted(which[self.rows], np.arange(len(first) + 1))
        self.code, (self.height, self.aspect) = code[first], measures[first, :2].T
        with np.errstate(all="ignore"):
            self.log_h, self.log_a = np.log(np.abs(self.height)), np.log(np.abs(self.aspect))
        wide = np.packbits(grown(np.unpackbits(grids[first], axis=1).reshape(-1, GRID, GRID).astype(bool)).reshape(-1, GRID * GRID), axis=1)
        self.grid, self.bare = np.ascontiguousarray(grids[first]).view(np.uint64), ~wide.view(np.uint64)
        self.ink = np.bitwise_count(self.grid).sum(1, dtype=np.int64)

    def asking(self, asks: np.ndarray) -> _Side:
        """The forms of the rows that ask; bitmaps and row numbers are those of the whole."""
        out, kept = copy.copy(self), asks[self.rows]
        which = np.repeat(np.arange(len(self.code)), np.diff(self.start))[kept]
        forms = np.unique(which)
        out.rows, out.start = self.rows[kept], np.searchsorted(which, np.append(forms, len(self.code)))
        for name in ("code", "height", "aspect", "log_h", "log_a", "grid", "bare", "ink"):
            setattr(out, name, getattr(self, name)[forms])
        return out


def _strays(left: _Side, i: np.ndarray, right: _Side, j: np.ndarray) -> np.ndarray:
    """Stray shares of pairs of forms; grids are compared as 64-bit words."""
    out = np.empty(len(i))
    for at in range(0, len(i), 4096):
        x, y = i[at : at + 4096], j[at : at + 4096]
        n = np.bitwise_count(left.grid[x] & right.bare[y]).sum(1, dtype=np.int64) + np.bitwise_count(right.grid[y] & left.bare[x]).sum(1, dtype=np.int64)
        out[at : at + 4096] = n / np.maximum(1, left.ink[x] + right.ink[y])
    return out


def _stray_pixels(left: _Side, some: np.ndarray, grid: np.ndarray, bare: np.ndarray, words: list[int]) -> np.ndarray:
    """Stray pixels, within ``words`` of the grids, of some forms against all that ``grid`` and ``bare`` hold word by word."""
    out = np.zeros((len(some), grid.shape[1]), np.uint16)
    for w in words:
        out += np.bitwise_count(left.grid[some, w, None] & bare[w])
        out += np.bitwise_count(left.bare[some, w, None] & grid[w])
    return out


def _like(left: _Side, some: np.ndarray, right: _Side, there: np.ndarray) -> np.ndarray:
    """Which pairs of forms pass the gates of height and aspect. Only next to a gate's limit the ratio itself decides."""
    h, a = np.abs(left.log_h[some, None] - right.log_h[there]), np.abs(left.log_a[some, None] - right.log_a[there])
    out = (h <= HEIGHT - 1e-9) & (a <= ASPECT - 1e-9)
    r, c = np.nonzero(((h <= HEIGHT + 1e-9) & (a <= ASPECT + 1e-9)) ^ out)
    i, j = some[r], there[c]
    out[r, c] = (np.abs(np.log(left.height[i] / right.height[j])) <= HEIGHT) & (np.abs(np.log(left.aspect[i] / right.aspect[j])) <= ASPECT)
    return out


def _near_forms(left: _Side, right: _Side, k: int, distance: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of forms of ``left`` and ``right`` with their stray shares: all of ``right`` that may be among the ``k`` nearest
    of one of ``left``, itself not counted. The pairs of a form of ``left`` come together.

    Every fourth word of two grids has at most the whole's stray ink. Of the ``k`` + 1 that stray least there the whole is
    measured, and then only of those that stray no more there than the farthest of these does as a whole. A form to
    which many are left is compared with all at once, word by word, which takes less time than to pick them out.
    """
    words = range(GRID_BYTES // 8)
    first, others = [w for w in words if w % 4 == 0], [w for w in words if w % 4]
    with np.errstate(all="ignore"):
        fine = np.clip(np.sqrt(len(left.code) / 500) // 1, 1, 4)  # the more forms the narrower the blocks that share a comparison
        block = np.stack([left.code, np.sign(left.height), np.sign(left.aspect), np.floor(left.log_h / HEIGHT * fine), np.floor(left.log_a / ASPECT * fine)], 1)
        _, which = np.unique(block, axis=0, return_inverse=True)
        order = np.argsort(which.ravel(), kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(which.ravel()[order])) + 1):
            h, a, one = left.log_h[mine], left.log_a[mine], mine[0]
            alike = (right.code == left.code[one]) & (np.sign(right.height) == np.sign(left.height[one])) & (np.sign(right.aspect) == np.sign(left.aspect[one]))
            there = np.flatnonzero(alike & (right.log_h >= h.min() - HEIGHT - 1e-9) & (right.log_h <= h.max() + HEIGHT + 1e-9) & (right.log_a >= a.min() - ASPECT - 1e-9) & (right.log_a <= a.max() + ASPECT + 1e-9))
            if not len(there):
                continue
            grid, bare = (np.ascontiguousarray(x[there].T) for x in (right.grid, right.bare))
            room = max(1, 65_536 // len(there))
            for some in (mine[s : s + room] for s in range(0, len(mine), room)):
                like, ink = _like(left, some, right, there), left.ink[some, None] + right.ink[there]
                part = _stray_pixels(left, some, grid, bare, first)
                least = np.where(like, part / ink, np.inf)
                limit = np.full(len(some), distance)
                if len(there) > k + 1:
                    best = np.argpartition(least, k, axis=1)[:, : k + 1]
                    whole = _strays(left, np.repeat(some, k + 1), right, there[best.ravel()]).reshape(best.shape)
                    limit = np.minimum(distance, np.where(np.take_along_axis(least, best, 1) < np.inf, whole, np.inf).max(1))
                left_over = least <= limit[:, None]
                many = np.flatnonzero(left_over.sum(1) > len(there) // 8)
                if len(many):
                    whole = np.where(like[many], (part[many] + _stray_pixels(left, some[many], grid, bare, others)) / ink[many], np.inf)
                    if len(there) > k + 1:
                        limit[many] = np.minimum(limit[many], np.partition(whole, k, axis=1)[:, k])
                    left_over[many] = whole <= limit[many, None]
                r, c = np.nonzero(left_over)
                stray = _strays(left, some[r], right, there[c])
                kept = stray <= limit[r]
                if kept.any():
                    yield some[r[kept]], there[c[kept]], stray[kept]


def _counted(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``count`` numbers from each ``start`` on."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())


def _near_rows(left: _Side, right: _Side, form: np.ndarray, forms: np.ndarray, stray: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Rows of ``left`` and ``right``, stray shares and ranks: the ``k`` nearest among the rows of pairs of forms, by share and id."""
    count = np.minimum(right.start[forms + 1] - right.start[forms], k + 1)
    rows, far, form = right.rows[_counted(right.start[forms], count)], np.repeat(stray, count), np.repeat(form, count)
    near = np.lexsort((right.ids[rows], far, form))
    rows, far, form = rows[near], far[near], form[near]
    form, begin, count = np.unique(form, return_index=True, return_counts=True)
    count = np.minimum(count, k + 1)
    asked = left.start[form + 1] - left.start[form]
    query, begin, count = left.rows[_counted(left.start[form], asked)], np.repeat(begin, asked), np.repeat(count, asked)
    at, which = _counted(begin, count), np.repeat(np.arange(len(query)), count)
    others = right.ids[rows[at]] != left.ids[query[which]]
    at, which = at[others], which[others]
    rank = np.arange(1, len(which) + 1, dtype=np.int32) - np.searchsorted(which, which).astype(np.int32)
    kept = rank <= k
    at, which = at[kept], which[kept]
    return query[which], rows[at], far[at], rank[kept]


def _found(left: _Side, right: _Side, k: int, distance: float, limit: int | None) -> pa.Table:
    pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32))]
    pairs += [_near_rows(left, right, *near, k) for near in _near_forms(left, right, k, distance)]
    i, j, stray, rank = (np.concatenate(x) for x in zip(*pairs, strict=True))
    alike = pa.nulls(len(i), pa.bool_())
    if limit is not None and len(i):
        held, passes = left.held[i] & right.held[j], np.zeros(len(i), bool)
        passes[held] = thick_alike(left.canvas, right.canvas, i[held], j[held], limit)
        alike = pa.array(passes, mask=~held)
    out = [pa.array(left.ids[i], pa.int64()), pa.array(right.ids[j], pa.int64()), pa.array(stray), pa.array(rank, pa.int32()), alike]
    return pa.table(out[: 4 + (limit is not None)], names=["shape_id", "other", "stray", "rank", "alike"][: 4 + (limit is not None)])


def _none_found(limit: int | None) -> pa.Table:
    kinds = [("shape_id", pa.int64()), ("other", pa.int64()), ("stray", pa.float64()), ("rank", pa.int32()), ("alike", pa.bool_())]
    return pa.schema(kinds[: 4 + (limit is not None)]).empty_table()


def _nearest(k: int, distance: float, limit: int | None):
    """The work on a tile: all its queries against the shapes around, and whether their canvases are alike if ``limit``."""

    def run(queries: pa.Table, around: pa.Table) -> pa.Table:
        if not len(queries) or not len(around):
            return _none_found(limit)
        codes, around = {}, around.rename_columns([c.removesuffix("_around") for c in around.column_names])
        return _found(_Side(queries, codes, limit is not None), _Side(around, codes, limit is not None), k, distance, limit)

    return run


def _nearest_own(k: int, distance: float, limit: int | None):
    """The same where the queries are those of the shapes around that ask."""

    def run(around: pa.Table) -> pa.Table:
        asks = around["asks"].to_numpy()
        if not asks.any():
            return _none_found(limit)
        right = _Side(around, {}, limit is not None)
        return _found(right.asking(asks), right, k, distance, limit)

    return run


def gated_neighbours(queries: DataFrame, catalog: DataFrame, *, k: int = CANDIDATES, distance: float = DISTANCE, limit: int | None = None) -> DataFrame:
    """(shape_id, other, stray, rank): the ``k`` nearest catalog shapes of equal band and holes, like height
    and aspect, within ``distance``; a shape is no neighbour of itself. With ``limit`` also alike,
    whether no thick blob by which their canvases differ is larger, null without two whole canvases.

    The cheap gates are tiles of like measures: a tile's shapes and those around meet in one task, and no pair
    is ever a row but those found. Where the queries are the catalog a shape is sent once to a tile, and asks in its own.
    Shapes without a whole grid or ink, or with a null measure, match nothing.
    """
    columns = ["shape_id", "band", "holes", "height", "aspect"]
    if limit is None:
        bits = lambda d: _usable(d).select(*columns, F.col("grid").alias("bits"))
    else:
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in catalog.select(*columns).schema.fields)
        bits = lambda d: _usable(d).select(*columns, "grid", "canvas").mapInArrow(_squeezed, f"{schema}, bits binary")
    found = "shape_id bigint, other bigint, stray double, rank int" + (", alike boolean" if limit is not None else "")
    right = _tiles(bits(catalog), True)
    if queries is catalog:
        return right.groupBy("tile").applyInArrow(_nearest_own(k, distance, limit), found)
    left = _tiles(bits(queries), False)
    right = right.toDF(*(f"{c}_around" for c in right.columns))  # the two sides may come from one frame
    return left.groupBy("tile").cogroup(right.groupBy("tile_around")).applyInArrow(_nearest(k, distance, limit), found)


def thick_tested(neighbours: DataFrame, queries: DataFrame, catalog: DataFrame, limit: int = THICK_BLOB) -> DataFrame:
    """Neighbours whose canvases differ by no thick blob, with its size."""
    left = queries.select("shape_id", F.col("canvas").alias("c1"))
    right = catalog.select(F.col("shape_id").alias("other"), F.col("canvas").alias("c2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [thick_blob(unpacked(a, CANVAS), unpacked(b, CANVAS)) if a is not None and b is not None else None for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(blobs, pa.int32())], names=["shape_id", "other", "stray", "rank", "blob"])

    pairs = neighbours.join(left, "shape_id").join(right, "other").select("shape_id", "other", "stray", "rank", "c1", "c2")
    return pairs.mapInArrow(run, "shape_id bigint, other bigint, stray double, rank int, blob int").where(F.col("blob") <= limit)


def best_match(tested: DataFrame) -> DataFrame:
    """(shape_id, match): the nearest that passed the thick test."""
    return tested.groupBy("shape_id").agg(F.min_by("other", "rank").alias("match"))


def matching_ids(tested: DataFrame) -> DataFrame:
    """(shape_id, matches): all that passed, by blob and id."""
    return tested.groupBy("shape_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("blob", "other"))), lambda m: m["other"]).alias("matches"))


def checks(occurrences: DataFrame, matches: DataFrame, own: str = "shape_id") -> DataFrame:
    """Adds verdict and rivals: drifted where the own id is not among the matches, ambiguous with others."""
    joined = occurrences.join(matches, own, "left").withColumn("matches", F.coalesce("matches", F.array().cast("array<bigint>")))
    verdict = F.when(~F.array_contains("matches", F.col(own)), "drifted").when(F.size("matches") > 1, "ambiguous").otherwise("clean")
    return joined.withColumn("verdict", verdict).withColumn("rivals", F.array_remove("matches", F.col(own)))


def _rows(n: str | None):
    """Number of occurrences: rows, or what rows of counted occurrences say in ``n``."""
    return F.count("*") if n is None else F.sum(n)


def verdict_census(checked: DataFrame, n: str | None = None) -> DataFrame:
    return checked.groupBy("verdict").agg(_rows(n).alias("count"))


def rival_pairs(checked: DataFrame, prototypes: DataFrame, n: str | None = None) -> DataFrame:
    """(first, second, count): pairs that share occurrences, and prototype pairs (shape_id, other) with 0."""
    shared = checked.withColumn("other", F.explode("rivals")).groupBy(F.least("shape_id", "other").alias("first"), F.greatest("shape_id", "other").alias("second")).agg(_rows(n).alias("count"))
    also = prototypes.select(F.least("shape_id", "other").alias("first"), F.greatest("shape_id", "other").alias("second"), F.lit(0).alias("count"))
    return shared.unionByName(also).groupBy("first", "second").agg(F.max("count").alias("count"))


def shared_rivals(near: DataFrame, counted: DataFrame, n: str = "n") -> DataFrame:
    """(first, second, count): ``rival_pairs`` where the neighbours (shape_id, other, alike) are the prototype pairs and, where alike,
    the rivals of a shape's occurrences, whose number is ``n`` of ``counted`` (shape_id, n). Neighbours are read only once."""
    shares = F.coalesce(F.sum(F.when(F.col("alike"), F.col(n))), F.lit(0))
    return near.join(counted, "shape_id", "left").groupBy(F.least("shape_id", "other").alias("first"), F.greatest("shape_id", "other").alias("second")).agg(shares.alias("count"))


def flagged(checked: DataFrame, n: str | None = None) -> DataFrame:
    """(shape_id, troubled): ids with occurrences that are ambiguous or drifted."""
    return checked.where("verdict <> 'clean'").groupBy("shape_id").agg(_rows(n).alias("troubled"))


def keep_assignments(found: DataFrame, previous: DataFrame, page: list[str], catalog: DataFrame | None = None) -> DataFrame:
    """Adds kept: the earlier shape id of a component with the same page, box and ink, if ``catalog`` has its
    id; null where the shape is to be assigned anew. Ids may have gaps, so their number is no bound."""
    there = [f"_{c}" for c in page]
    before = previous.select(*(F.col(c).alias(f"_{c}") for c in page), F.col("bbox").alias("_box"), F.col("ink").alias("_ink"), F.col("shape_id").alias("kept")).dropDuplicates([*there, "_box"])
    if catalog is not None:
        before = before.join(maybe_broadcast(pick(catalog, "shape_id").distinct().toDF("kept")), "kept", "left_semi")
    match = F.col("bbox") == F.col("_box")
    for c in page:
        match &= F.col(c) == F.col(f"_{c}")
    joined = found.join(before, match, "left").drop(*there, "_box")
    return joined.withColumn("kept", F.when(F.col("ink") == F.col("_ink"), F.col("kept"))).drop("_ink")


def lead_clusters(shapes: DataFrame, order: list[str], ident: str) -> DataFrame:
    """(``ident``, leader): online clustering in ``order``; a shape joins the first of its eight nearest
    leaders that passes the thick test, else leads. Leaders' measures and bitmaps follow their members.

    Band and holes are hard gates, so their groups are clustered apart, each in one task as the order
    demands; for collections whose groups outgrow a task use the catalog in its frozen form (gated_neighbours).
    """
    schema = f"`{ident}` {shapes.schema[ident].dataType.simpleString()}, leader {shapes.schema[ident].dataType.simpleString()}"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        leaders, sums, grids, canvas_sums, canvases, heights, aspects, counts, out = [], [], np.zeros((0, GRID, GRID), bool), [], [], [], [], [], []
        for row in frame.itertuples():
            grid, canvas = unpacked(row.grid, (GRID, GRID)), unpacked(row.canvas, CANVAS)
            at = None
            if leaders and grid.any():
                ok = np.flatnonzero((np.abs(np.log(row.height / np.array(heights))) <= HEIGHT) & (np.abs(np.log(row.aspect / np.array(aspects))) <= ASPECT))
                if len(ok):
                    d = stray_share(grid, grids[ok])
                    near = [i for i in np.argsort(d, kind="stable")[:CANDIDATES] if d[i] <= DISTANCE]
                    at = next((int(ok[i]) for i in near if thick_blob(canvas, canvases[ok[i]]) <= THICK_BLOB), None)
            if at is None:
                at = len(leaders)
                leaders.append(getattr(row, ident))
                sums.append(np.zeros((GRID, GRID), np.int32))
                canvas_sums.append(np.zeros(CANVAS, np.int32))
                grids, canvases = np.concatenate([grids, grid[None]]), [*canvases, canvas]
                heights.append(row.height)
                aspects.append(row.aspect)
                counts.append(0)
            counts[at] += 1
            heights[at] += (row.height - heights[at]) / counts[at]
            aspects[at] += (row.aspect - aspects[at]) / counts[at]
            sums[at] += grid
            canvas_sums[at] += canvas
            grids[at], canvases[at] = 2 * sums[at] >= counts[at], 2 * canvas_sums[at] >= counts[at]
            out.append((getattr(row, ident), leaders[at]))
        return pd.DataFrame(out, columns=[ident, "leader"])

    ready = shapes.where((F.length("grid") == GRID * GRID // 8) & (F.length("canvas") == CANVAS[0] * CANVAS[1] // 8) & F.col("height").isNotNull() & F.col("aspect").isNotNull())
    return ready.groupBy("band", "holes").applyInPandas(run, schema)


def rank_pages(occurrences: DataFrame, book: list[str], page: str = "page") -> DataFrame:
    """(``book``, page, rank, shapes, new_shapes, covered): pages in the order that shows most unseen shapes
    first, the lowest page among equals, with the share of occurrences covered so far.

    A page enters with its distinct shapes and their counts in the book, which bounds a book's group. A
    page's count of unseen shapes only falls, so a heap of last known counts finds the next page lazily.
    """
    used = occurrences.where("shape_id is not null")
    counts = used.groupBy(*book, "shape_id").agg(F.count("*").alias("n"))
    pairs = used.select(*book, page, "shape_id").distinct().join(counts, [*book, "shape_id"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*book, page).schema.fields)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        weight = dict(zip(frame["shape_id"], frame["n"], strict=True))
        total = sum(weight.values())
        shapes = {p: set(g) for p, g in frame.groupby(page)["shape_id"]}
        heap = [(-len(s), p) for p, s in shapes.items()]
        heapq.heapify(heap)
        seen, covered, out = set(), 0, []
        while heap:
            known, p = heapq.heappop(heap)
            new = shapes[p] - seen
            if -len(new) != known:
                heapq.heappush(heap, (-len(new), p))
                continue
            seen |= new
            covered += sum(weight[s] for s in new)
            out.append((p, len(out) + 1, len(shapes[p]), len(new), covered / total))
        result = pd.DataFrame(out, columns=[page, "rank", "shapes", "new_shapes", "covered"])
        for b in book:
            result[b] = frame[b].iloc[0]
        return result[[*book, page, "rank", "shapes", "new_shapes", "covered"]]

    return pairs.groupBy(*book).applyInPandas(run, f"{schema}, rank int, shapes int, new_shapes int, covered double")


def same_shapes(shapes: DataFrame, crops: DataFrame, excluded: DataFrame | None = None, *, share: float = 0.5) -> DataFrame:
    """(shape_id, same array<bigint>): shapes that may be the same letter, the nearest first.

    Of the ``WIDE`` nearest within ``WIDE_STRAY`` those are kept from which at least ``share`` of the shape's crops
    (shape_id, canvas) differ by no thick blob. Shapes of ``excluded`` (shape_id) are suggested to none; a shape
    without crops has no suggestion.
    """
    offered = shapes if excluded is None else shapes.join(pick(excluded, "shape_id").distinct(), "shape_id", "left_anti")
    if crops is shapes:  # a shape's canvas is its only crop
        near = gated_neighbours(shapes, offered, k=WIDE, distance=WIDE_STRAY, limit=THICK_BLOB).where("alike")
        return near.groupBy("shape_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other"))), lambda x: x["other"]).alias("same"))
    near = gated_neighbours(shapes, offered, k=WIDE, distance=WIDE_STRAY)
    left = crops.where(F.length("canvas") == CANVAS[0] * CANVAS[1] // 8).select("shape_id", F.col("canvas").alias("c1"))
    right = offered.where(F.length("canvas") == CANVAS[0] * CANVAS[1] // 8).select(F.col("shape_id").alias("other"), F.col("canvas").alias("c2"))
    pairs = near.join(left, "shape_id").join(right, "other").select("shape_id", "other", "rank", "c1", "c2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 512) for at in range(0, len(batch), 512)):
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(-1, CANVAS_BYTES) for c in (3, 4))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(thick_blobs(a, b) <= THICK_BLOB)], names=["shape_id", "other", "rank", "passes"])

    tested = pairs.mapInArrow(run, "shape_id bigint, other bigint, rank int, passes boolean")
    kept = tested.groupBy("shape_id", "other", "rank").agg(F.avg(F.col("passes").cast("double")).alias("share")).where(F.col("share") >= share)
    return kept.groupBy("shape_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other"))), lambda x: x["other"]).alias("same"))
