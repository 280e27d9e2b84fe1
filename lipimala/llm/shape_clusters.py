"""Clusters of shapes that show the same printed form.

An approximate nearest-neighbour graph is built by neighbour descent (Dong et al., "Efficient k-nearest
neighbor graph construction for generic similarity measures", 2011). Shapes are laid out in a few orders and
cut into blocks of bounded size; in every block each list of neighbours is improved by the neighbours of its
neighbours until the lists stay as they are. The lists of all orders are merged and improved across blocks in
the same way: where two neighbours of a shape have not met in a block they are compared. Modularity-based
community detection (Blondel et al., "Fast unfolding of communities in large networks", 2008) then groups the
shapes: nodes move within their blocks first, communities become nodes, and these move until none gains. A
cluster is a community, described by its members of highest internal weighted degree.

Distance of two grids: the share of ink that lies more than one pixel from the other's ink, both ways. Only
pairs within the distance that separates forms become edges. The canvas gives a second measure of size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lipimala.runtime import cut, hot_join, pick, uncut

SIDE = 48
BYTES = SIDE * SIDE // 8
CANVAS = (128, 32)  # rows and bytes of a row
#: Largest distance of two prints of one form, and largest difference of their log heights, log aspects and log canvas heights.
NEAR, HEIGHT, ASPECT, SIZE = 0.06, 0.08, 0.15, 0.25
#: Neighbours kept, and held while a block settles, rows of a block, sorted orders searched first in a block, coarse
#: cells of an order and rows compared with in each.
K, WIDTH, BLOCK, SEARCHES, CELLS, REACH = 8, 12, 8192, 8, 16, 4
#: Descent ends when a smaller share of all list places changes.
STILL = 0.001
#: Resolution of modularity. At 1 the null model splits sparse neighbour lists of one form once it holds a good
#: part of all shapes; a tenth keeps a form whole and still parts forms that hang together by a stray edge.
RESOLUTION = 0.1
_FOUND = "u bigint, v bigint, d double, block int"


def _packed(column: pa.Array) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.uint8).reshape(-1, BYTES)


def _words(grids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grids and grids grown by a pixel as 64-bit words, and the ink of each."""
    bits = np.unpackbits(grids, axis=1).reshape(-1, SIDE, SIDE)
    wide = bits.copy()
    wide[:, 1:] |= bits[:, :-1]
    wide[:, :-1] |= bits[:, 1:]
    grown = wide.copy()
    grown[:, :, 1:] |= wide[:, :, :-1]
    grown[:, :, :-1] |= wide[:, :, 1:]
    big = np.packbits(grown.reshape(-1, SIDE * SIDE), axis=1)
    ink = np.bitwise_count(grids).sum(1, dtype=np.int64)
    return np.ascontiguousarray(grids).view(np.uint64), np.ascontiguousarray(big).view(np.uint64), ink


def _coarse(grids: np.ndarray) -> np.ndarray:
    """Ink of each of 8 x 8 cells."""
    return np.unpackbits(grids, axis=1).reshape(-1, 8, 6, 8, 6).sum((2, 4), dtype=np.int16).reshape(len(grids), 64)


class Shapes:
    """Rows (id, band, h, a, size, grid) of a batch and the distances of pairs of them."""

    COLUMNS = ("id", "band", "h", "a", "size")

    def __init__(self, ids: np.ndarray, band: np.ndarray, h: np.ndarray, a: np.ndarray, size: np.ndarray, grids: np.ndarray) -> None:
        self.ids, self.band, self.h, self.a, self.size, self.grids = ids, band, h, a, size, grids
        self.grid, self.grown, self.ink = _words(grids)

    @classmethod
    def of(cls, table: pa.Table) -> Shapes:
        return cls(*(np.asarray(table[c].combine_chunks()) for c in cls.COLUMNS), _packed(table["grid"].combine_chunks()))

    def fits(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs are of one band and size; a size that is not known fits any."""
        size = np.nan_to_num(np.abs(self.size[i] - self.size[j]), nan=0.0)
        return (self.band[i] == self.band[j]) & (np.abs(self.h[i] - self.h[j]) <= HEIGHT) & (np.abs(self.a[i] - self.a[j]) <= ASPECT) & (size <= SIZE) & (self.ids[i] != self.ids[j])

    def distance(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        d = np.empty(len(i))
        for k in range(0, len(i), 1 << 14):
            x, y = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
            stray = np.bitwise_count(self.grid[x] & ~self.grown[y]).sum(1, dtype=np.int64) + np.bitwise_count(self.grid[y] & ~self.grown[x]).sum(1, dtype=np.int64)
            d[k : k + (1 << 14)] = stray / (self.ink[x] + self.ink[y])
        return d


class Descent:
    """Neighbour lists of the shapes of a block, of the pairs that fit in band and size."""

    def __init__(self, shapes: Shapes, k: int = WIDTH, seed: int = 0) -> None:
        self.shapes, self.k, n = shapes, k, len(shapes.ids)
        self.near, self.d, self.fresh = np.full((n, k), -1), np.full((n, k), np.inf), np.zeros((n, k), bool)
        coarse = _coarse(shapes.grids)
        rng = np.random.default_rng(seed)
        for _ in range(SEARCHES):  # sorted by the signs of a few coarse cells, then by height: worn prints stand side by side
            cells = rng.choice(64, CELLS, replace=False)
            order = np.lexsort((shapes.h, (coarse[:, cells] > 18) @ (1 << np.arange(CELLS)), shapes.band))
            for step in range(1, REACH + 1):
                self._offer(np.r_[order[:-step], order[step:]], np.r_[order[step:], order[:-step]])

    def _offer(self, i: np.ndarray, j: np.ndarray) -> int:
        """Takes up the pairs that are better than what the lists hold; returns how many places changed."""
        ok = (j >= 0) & (i != j)
        i, j = i[ok], j[ok]
        key = np.sort(i * len(self.near) + j)
        key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
        i, j = key // len(self.near), key % len(self.near)
        ok = self.shapes.fits(i, j) & ~(self.near[i] == j[:, None]).any(1)
        i, j = i[ok], j[ok]
        d = self.shapes.distance(i, j)
        ok = d < self.d[i, -1]
        i, j, d = i[ok], j[ok], d[ok]
        if not len(i):
            return 0
        rows = np.unique(i)
        owner = np.r_[np.repeat(rows, self.k), i]
        other, far = np.r_[self.near[rows].ravel(), j], np.r_[self.d[rows].ravel(), d]
        fresh = np.r_[np.zeros(len(rows) * self.k, bool), np.ones(len(i), bool)]
        held = np.r_[self.fresh[rows].ravel(), np.zeros(len(i), bool)]
        order = np.lexsort((fresh, far, owner))  # of equal distances what is held stays
        owner, other, far, fresh = owner[order], other[order], far[order], fresh[order]
        start = np.searchsorted(owner, rows)
        rank = np.arange(len(owner)) - np.repeat(start, np.diff(np.r_[start, len(owner)]))
        keep = rank < self.k
        owner, rank = owner[keep], rank[keep]
        self.near[owner, rank], self.d[owner, rank], self.fresh[owner, rank] = other[keep], far[keep], fresh[keep] | held[order][keep]
        return int(fresh[keep].sum())

    def settle(self, still: float = STILL) -> None:
        """Compares each shape with its neighbours' neighbours and with those that name it until hardly any list changes."""
        n, k = self.near.shape
        while True:
            open_ = self.d[:, -1] > 0  # a list full of distance 0 can't improve
            fresh, self.fresh = self.fresh & (self.near >= 0), np.zeros((n, k), bool)
            rows = np.flatnonzero(open_ & (fresh.any(1) | fresh[self.near].any((1, 2))))
            one = self.near[rows]
            two = self.near[one]
            new = (fresh[rows][:, :, None] | fresh[one]) & (one >= 0)[:, :, None] & (two >= 0)  # of old neighbours only what is new to them
            at, by, to = np.nonzero(new)
            owner, slot = np.nonzero(fresh)
            named = self.near[owner, slot]
            back = open_[named]
            if self._offer(np.r_[rows[at], named[back]], np.r_[two[at, by, to], owner[back]]) <= still * n * k:
                return

    def pairs(self, most: float = NEAR, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, place = np.nonzero(self.d[:, :k] <= most)
        return i, self.near[i, place], self.d[i, place]


def _tables(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _settled(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Neighbour lists within blocks; a row without v names the block of a shape."""
    part = TaskContext.get().partitionId()
    for number, table in enumerate(_tables(batches, 2 * block)):
        shapes = Shapes.of(table)
        descent = Descent(shapes, seed=number)
        descent.settle()
        i, j, d = descent.pairs()
        name = np.full(len(i), part, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(shapes.ids[i]), pa.array(shapes.ids[j]), pa.array(d), pa.array(name)], names=["u", "v", "d", "block"])
        n = len(shapes.ids)
        yield pa.RecordBatch.from_arrays([pa.array(shapes.ids), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.array(np.full(n, part, np.int32))], names=["u", "v", "d", "block"])


def _local_joins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by w: compares those neighbours of a w that have not met, if the list of one may improve."""
    tail: pa.Table | None = None

    def join(table: pa.Table) -> pa.RecordBatch:
        w, mask, full = (np.asarray(table[c].combine_chunks()) for c in ("w", "mask", "full"))
        shapes, found = Shapes.of(table), []
        for step in range(1, 2 * K):
            i = np.flatnonzero(w[:-step] == w[step:]) if len(w) > step else np.zeros(0, np.int64)
            if not len(i):
                break
            i = i[((mask[i] & mask[i + step]) == 0) & ~(full[i] & full[i + step])]
            i = i[shapes.fits(i, i + step)]
            d = shapes.distance(i, i + step)
            near = d <= NEAR
            found += [(shapes.ids[i[near]], shapes.ids[i[near] + step], d[near]), (shapes.ids[i[near] + step], shapes.ids[i[near]], d[near])]
        u, v, d = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(d)], names=["u", "v", "d"])

    for table in _tables(batches, 20_000):
        whole = pa.concat_tables([tail, table]) if tail is not None else table
        last = np.asarray(whole["w"].combine_chunks())
        stop = int(np.searchsorted(last, last[-1]))  # the last w may go on in the next batch; a w has 2 K rows at most
        if stop:
            yield join(whole.slice(0, stop))
        tail = whole.slice(stop)
    if tail is not None and tail.num_rows:
        yield join(tail)


def _signature(seed: int):
    """16 of 64 coarse cells of the grid, each ink if it has more ink than half: alike for worn prints."""
    cells = np.random.default_rng(seed).choice(64, 16, replace=False)

    @F.pandas_udf("int")
    def of(grid):
        bits = np.unpackbits(np.frombuffer(b"".join(grid), np.uint8).reshape(-1, BYTES), axis=1)
        coarse = bits.reshape(-1, 8, 6, 8, 6).sum((2, 4)).reshape(-1, 64)[:, cells] > 18
        return pd.Series(coarse @ (1 << np.arange(16)))

    return of


def _best(lists: DataFrame, k: int, *more: str) -> DataFrame:
    """The ``k`` nearest of every node's list (u, v, d)."""
    rank = F.row_number().over(Window.partitionBy("u").orderBy("d", F.xxhash64("u", "v"), "v"))
    return lists.withColumn("rank", rank).where(F.col("rank") <= k).select("u", "v", "d", *more)


def _merged(lists: DataFrame) -> DataFrame:
    """Lists (u, v, d, mask) of several searches as one, in which an entry's mask names the searches that know it."""
    return _best(lists.groupBy("u", "v").agg(F.min("d").alias("d"), F.bit_or("mask").alias("mask")), K, "mask")


def neighbour_graph(shapes: DataFrame, *, block: int = BLOCK, still: float = STILL) -> tuple[DataFrame, DataFrame]:
    """(lists, blocks) from rows (id, band, h, a, size, grid): lists (u, v, d) holds the nearest neighbours of each
    u within ``NEAR``, at most ``K``; blocks (id, block) puts like shapes into blocks of bounded size.

    Searches across blocks go on until a smaller share than ``still`` of all list places changes.
    """
    rows = shapes.count()
    parts = max(1, -(-rows // block))
    found, orders = None, ([_signature(1)("grid"), "h"], [_signature(2)("grid"), "a"])
    for number, order in enumerate(orders):
        by = ["band", "key", order[1], "id"]
        spread = shapes.withColumn("key", order[0]).repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("key")
        lists = spread.mapInArrow(lambda it: _settled(it, block), _FOUND).withColumn("mask", F.lit(1 << number).cast("bigint"))
        found = lists if found is None else found.unionByName(lists)
    found = cut(found, "found")
    blocks = cut(found.where((F.col("mask") == 1) & F.col("v").isNull()).select(F.col("u").alias("id"), "block"), "blocks")
    lists = cut(_merged(found.where("v is not null").drop("block")), "lists")
    uncut(found)
    turn = len(orders)
    while rows:
        full = lists.groupBy("u").agg(F.count("*").alias("n"), F.max("d").alias("far")).where((F.col("n") == K) & (F.col("far") == 0)).select(F.col("u").alias("id"), F.lit(True).alias("full"))
        both = lists.unionByName(lists.select(F.col("v").alias("u"), F.col("u").alias("v"), "d", "mask")).groupBy("u", "v").agg(F.min("d").alias("d"), F.bit_or("mask").alias("mask"))
        around = _best(both, 2 * K, "mask").select(F.col("u").alias("w"), F.col("v").alias("id"), "mask").join(full, "id", "left").withColumn("full", F.coalesce("full", F.lit(False)))
        held = around.groupBy("w").agg(F.collect_list(F.struct("id", "mask", "full")).alias("held"))  # 2 K at most
        recent = F.lit(1 << (turn - 1)).cast("bigint")
        apart = lambda x, y: (x["mask"].bitwiseAND(y["mask"]) == 0) & ((x["mask"].bitwiseAND(recent) != 0) | F.lit(turn == len(orders)))  # noqa: B023, E731
        active = held.where(F.exists("held", lambda x: F.exists("held", lambda y: (x["id"] != y["id"]) & ~(x["full"] & y["full"]) & apart(x, y))))
        local = active.select("w", F.explode("held").alias("x")).select("w", "x.*").join(shapes, "id").repartition("w").sortWithinPartitions("w", "id")
        more = local.select("w", "mask", "full", *Shapes.COLUMNS, "grid").mapInArrow(_local_joins, "u bigint, v bigint, d double")
        fresh = more.withColumn("mask", F.lit(1 << turn).cast("bigint"))
        better = cut(_merged(lists.unionByName(fresh)), "lists")
        uncut(lists)
        lists = better
        changed = lists.where(F.col("mask") == (1 << turn)).count()
        turn += 1
        if changed <= still * rows * K or turn > 62:
            break
    return lists.select("u", "v", "d"), blocks


def _moves(links: list[tuple], degree: dict[int, float], total: float, resolution: float) -> dict[int, int]:
    """Community of every node of a block's links (u, v, w): nodes move to the neighbouring community of highest
    gain until none gains, communities become nodes, until nothing merges. ``degree`` counts links to other
    blocks too, and ``total`` is the weight of the whole graph."""
    member = {u: u for u in degree}
    degree = dict(degree)
    while True:
        near: dict[int, dict[int, float]] = defaultdict(dict)
        for u, v, w in links:
            if u != v:
                near[u][v] = near[u].get(v, 0.0) + w
        at = {u: u for u in degree}
        mass = dict(degree)
        moved = True
        while moved:
            moved = False
            for u in sorted(near):
                to: dict[int, float] = defaultdict(float)
                for v, w in near[u].items():
                    to[at[v]] += w
                own, k = at[u], degree[u]
                gain = lambda c: to.get(c, 0.0) - resolution * k * (mass[c] - (k if c == own else 0.0)) / total  # noqa: B023, E731
                best = max(to, key=lambda c: (gain(c), -c))
                if best != own and gain(best) > gain(own) + 1e-9:
                    mass[own] -= k
                    mass[best] += k
                    at[u], moved = best, True
        if all(c == u for u, c in at.items()):
            return member
        member = {u: at[c] for u, c in member.items()}
        merged: dict[tuple, float] = defaultdict(float)
        for u, v, w in links:
            merged[at[u], at[v]] += w
        links = [(u, v, w) for (u, v), w in merged.items()]
        degree = {c: m for c, m in mass.items() if c in set(at.values())}


def _block_communities(total: float, resolution: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        degree = frame.groupby("u", sort=True)["w"].sum()
        inside = frame[frame["inside"]]
        links = sorted(zip(inside["u"].tolist(), inside["v"].tolist(), inside["w"].tolist(), strict=True))
        found = _moves(links, dict(zip(degree.index.tolist(), degree.tolist(), strict=True)), total, resolution)
        return pd.DataFrame(list(found.items())).astype("int64")  # columns by place

    return run


def communities(edges: DataFrame, blocks: DataFrame | None = None, *, resolution: float = RESOLUTION, block: int = BLOCK) -> DataFrame:
    """(id, community) of every node of the weighted edges (u, v, w), u <> v, each link given once.

    ``blocks`` (id, block) are sets of nodes of bounded size in which communities are formed first. Then, over
    all blocks, communities are nodes and move to the neighbouring community of highest modularity gain, a
    random half of them in each turn so that no two swap places, until none gains; what has merged becomes the
    nodes of the next level, until a level merges nothing. What is left to move is moved in one task as soon as it
    is no more than a block's links.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    links = cut(both.groupBy("u", "v").agg(F.sum("w").alias("w")), "links")
    total, rows = links.agg(F.sum("w"), F.count("*")).first()
    if not total:
        member = links.select(F.col("u").alias("id"), F.col("u").alias("community"))
        return member
    if blocks is None:
        member = cut(links.select(F.col("u").alias("id"), F.col("u").alias("community")).distinct(), "member")
    else:
        placed = links.join(blocks.toDF("u", "bu"), "u", "left").join(blocks.toDF("v", "bv"), "v", "left")
        local = placed.select("u", "v", "w", F.coalesce("bu", -F.pmod(F.xxhash64("u"), F.lit(1 + rows // (BLOCK * K))) - 1).alias("block"), F.coalesce(F.col("bu") == F.col("bv"), F.lit(False)).alias("inside"))
        member = cut(local.groupBy("block").applyInPandas(_block_communities(total, resolution), "id bigint, community bigint"), "member")
        links = _contracted(links, member.select(F.col("id").alias("u"), F.col("community").alias("c")), rows)
    turn = 0
    while True:
        open_ = links.where("u <> v")
        left = open_.limit(block * K + 1).count()
        if not left:
            break
        if left <= block * K:
            rest = links.join(open_.select("u").distinct(), "u", "left_semi").withColumns({"block": F.lit(0), "inside": F.lit(True)})
            at = rest.groupBy("block").applyInPandas(_block_communities(total, resolution), "u bigint, c bigint")
            merged = cut(member.withColumnRenamed("community", "u").join(at, "u", "left").select("id", F.coalesce("c", "u").alias("community")), "member")
            uncut(member)
            member = merged
            break
        count = float(links.count())
        nodes = cut(links.groupBy("u").agg(F.sum("w").alias("k"), F.count("*").alias("n")).withColumn("c", F.col("u")), "nodes")
        open_ = cut(hot_join(open_, nodes.select("u", "k", "n"), "u", "n", count), "open")
        while True:
            # as links hold both ways, a community is met by as many rows as its nodes have links
            mass = nodes.groupBy("c").agg(F.sum("k").alias("mass"), (F.sum("n") + F.count("*")).alias("n"))
            to = hot_join(open_, nodes.select(F.col("u").alias("v"), "c", "n"), "v", "n", count).select("u", "k", "c", "w", F.lit(False).alias("own"))
            choice = to.unionByName(nodes.select("u", "k", "c", F.lit(0.0).alias("w"), F.lit(True).alias("own")))
            choice = choice.groupBy("u", "c").agg(F.sum("w").alias("w"), F.max("own").alias("own"), F.max("k").alias("k"))
            gain = F.col("w") - resolution * F.col("k") * (F.col("mass") - F.when(F.col("own"), F.col("k")).otherwise(0.0)) / total
            weighed = hot_join(choice, mass, "c", "n", 2 * count).withColumn("gain", F.round(gain, 9))
            best = weighed.groupBy("u").agg(F.max(F.struct("gain", "own", (-F.col("c")).alias("low"))).alias("best"), F.max(F.when(F.col("own"), F.col("c"))).alias("old"))
            may = F.pmod(F.xxhash64("u", F.lit(turn)), F.lit(2)) == 0
            target = -F.col("best.low")
            moved = cut(best.select("u", F.when(may, target).otherwise(F.col("old")).alias("c"), (target != F.col("old")).alias("wants")).join(nodes.select("u", "k", "n"), "u"), "nodes")
            uncut(nodes)
            nodes, turn = moved, turn + 1
            if nodes.where("wants").isEmpty():
                break
        uncut(open_)
        at = nodes.select("u", "c")
        merged = cut(member.withColumnRenamed("community", "u").join(at, "u", "left").select("id", F.coalesce("c", "u").alias("community")), "member")
        same = nodes.where("u <> c").isEmpty()
        contracted = None if same else _contracted(links, at, count)
        uncut(member)
        uncut(nodes)
        member = merged
        if same:
            break
        links = contracted
    uncut(links)
    return member


def _contracted(links: DataFrame, at: DataFrame, count: float) -> DataFrame:
    """The links between the communities ``at`` (u, c) that their nodes are in."""
    sizes = links.groupBy("u").agg(F.count("*").alias("n"))
    known = at.join(sizes, "u")
    here = hot_join(links, known.select("u", F.col("c").alias("cu"), "n"), "u", "n", count)
    there = hot_join(here, known.select(F.col("u").alias("v"), F.col("c").alias("cv"), "n"), "v", "n", count)
    out = cut(there.groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")), "links")
    uncut(links)
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the canvas by the log of the rows that its ink spans; null where there is none."""
    for batch in batches:
        sizes = np.full(batch.num_rows, np.nan)
        held = [(i, c) for i, c in enumerate(batch.column("canvas").to_pylist()) if c is not None and len(c) == CANVAS[0] * CANVAS[1]]
        if held:
            ink = np.frombuffer(b"".join(c for _, c in held), np.uint8).reshape(-1, *CANVAS).any(2)
            span = CANVAS[0] - ink[:, ::-1].argmax(1) - ink.argmax(1)
            sizes[[i for i, _ in held]] = np.where(ink.any(1), np.log(np.maximum(span, 1)), np.nan)
        keep = [i for i, name in enumerate(batch.schema.names) if name != "canvas"]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(sizes)], names=[*(batch.schema.names[i] for i in keep), "size"])


def usable_shapes(catalog: DataFrame) -> DataFrame:
    """(id, band, h, a, grid, size), one row per shape; without a whole grid, ink, height or aspect a shape is in no cluster.

    A null band is a band of its own. A null or empty canvas gives no size.
    """
    blank = F.unhex(F.lit("00" * BYTES))
    rows = pick(catalog, "shape_id", "band", "height", "aspect", "grid", "canvas").select(
        F.col("shape_id").cast("bigint").alias("id"), F.xxhash64(F.coalesce("band", F.lit("?"))).alias("band"), F.log("height").alias("h"), F.log("aspect").alias("a"), F.col("grid").alias("grid"), "canvas"
    ).where("id is not null and grid is not null and h is not null and a is not null")
    rows = rows.where((F.length("grid") == BYTES) & (F.col("grid") != blank))
    return rows.mapInArrow(_measured, "id bigint, band bigint, h double, a double, grid binary, size double").dropDuplicates(["id"])


def shape_clusters(catalog: DataFrame) -> DataFrame:
    """Members (cluster_id, shape_id, degree) of all clusters of two or more shapes.

    ``degree`` is the weighted degree within the cluster. Exact copies (same grid, band and height) enter
    the graph as one and come out as their own members with its degree.
    """
    shapes = cut(usable_shapes(catalog), "shapes")
    rows = float(shapes.count())
    alike = F.concat_ws(" ", F.sha2("grid", 256), F.col("band"), F.round(F.col("h") * 100).cast("int")).alias("alike")
    keyed = shapes.select("id", alike)
    firsts = keyed.groupBy("alike").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    copies = cut(hot_join(keyed, firsts, "alike", "n", rows).select("first", "id"), "copies")
    unique = cut(shapes.join(copies.select(F.col("first").alias("id")).distinct(), "id", "left_semi"), "unique")
    uncut(shapes)
    lists, blocks = neighbour_graph(unique)
    edges = cut(lists.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), (F.lit(1.05) - F.col("d") / NEAR).alias("w")).distinct(), "edges")
    found = communities(edges, blocks)
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    inside = both.join(found.toDF("u", "cu"), "u").join(found.toDF("v", "cv"), "v").where("cu = cv")
    degree = inside.groupBy("u").agg(F.sum("w").alias("degree"))
    described = unique.select("id").join(found, "id", "left").join(degree.withColumnRenamed("u", "id"), "id", "left")
    described = cut(described.select(F.col("id").alias("first"), F.coalesce("community", "id").alias("community"), F.coalesce("degree", F.lit(0.0)).alias("degree")), "described")
    for done in (lists, blocks, edges, found, unique):
        uncut(done)
    counts = copies.groupBy("first").agg(F.count("*").alias("n"))
    members = hot_join(copies, described.join(counts, "first"), "first", "n", rows).select("community", F.col("id").alias("shape_id"), "degree")
    sizes = members.groupBy("community").agg(F.min("shape_id").alias("cluster_id"), F.count("*").alias("n")).where("n > 1")
    return hot_join(members, sizes, "community", "n", rows).select("cluster_id", "shape_id", "degree")


def cluster_members(catalog: DataFrame) -> DataFrame:
    """(cluster_id, shape_id): every shape of a cluster of two or more; its least shape_id names it."""
    return shape_clusters(catalog).select("cluster_id", "shape_id")


def cluster_descriptions(catalog: DataFrame, *, typical: int = 3) -> DataFrame:
    """(cluster_id, size, typical array<bigint>): the members of highest internal weighted degree."""
    members = shape_clusters(catalog)
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("degree"), "shape_id"))
    size = F.count("*").over(Window.partitionBy("cluster_id"))
    top = members.withColumn("size", size).withColumn("rank", rank).where(F.col("rank") <= typical)
    return top.groupBy("cluster_id", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "shape_id"))), lambda x: x["shape_id"]).alias("typical"))
