"""Items of varying length in containers of fixed capacity, with conflicts kept apart.

Conflict-constrained best fit, hardest item first. Open bins are ordered by residual space; each residual has
a bitmap of its bins, and each source and each cluster of copies a bitmap of the bins that hold it. The search
takes the residuals upwards from the item's size and stops at the first, which is the tightest, that has a bin
without conflict; where there is none a bin is opened. Where a source or cluster has more items than there are
bins, only the surplus shares bins, evenly. Items are spread over splits of bounded size by hash and each split
fills its own bins, so work and memory of a task don't grow with the collection.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lipimala.llm.byte_bpe import VOCABULARY, count_tokens
from lipimala.runtime import cut, pick

#: Tokens of a container, and items of a split.
CAPACITY, SPLIT = 4096, 8192


class Bins:
    """The open bins of a split."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.residuals = capacity, []
        self.at: dict[int, int] = {}  # residual -> bitmap of its bins
        self.some = 0  # bitmap of the residuals that have bins
        self.levels: dict[tuple, list[int]] = {}  # conflict key -> bitmaps of the bins with more than 0, 1, 2 ... of its items
        self.held: Counter = Counter()  # items of a key in a bin

    def tightest(self, size: int, against: int) -> int | None:
        """The bin of least residual that takes ``size`` and is not in the bitmap ``against``."""
        left = self.some >> size
        residual = size
        while left:
            step = (left & -left).bit_length() - 1
            residual += step
            free = self.at[residual] & ~against
            if free:
                return (free & -free).bit_length() - 1
            left >>= step + 1
            residual += 1
        return None

    def put(self, size: int, place: int | None, keys: list[tuple]) -> int:
        if place is None:
            place = len(self.residuals)
            self.residuals.append(self.capacity)
        else:
            self._drop(place)
        self.residuals[place] -= size
        rest = self.residuals[place]
        self.at[rest] = self.at.get(rest, 0) | (1 << place)
        self.some |= 1 << rest
        for key in keys:
            levels, n = self.levels.setdefault(key, []), self.held[key, place]
            self.held[key, place] += 1
            if n == len(levels):
                levels.append(0)
            levels[n] |= 1 << place
        return place

    def with_more(self, keys: list[tuple], n: int) -> int:
        """Bitmap of the bins that hold more than ``n`` items of one of the keys."""
        found = 0
        for key in keys:
            levels = self.levels.get(key, ())
            if n < len(levels):
                found |= levels[n]
        return found

    def _drop(self, place: int) -> None:
        rest = self.residuals[place]
        self.at[rest] &= ~(1 << place)
        if not self.at[rest]:
            self.some &= ~(1 << rest)


def best_fit(sizes: list[int], sources: list, copies: list, capacity: int) -> list[int]:
    """The bin of every item; no size exceeds ``capacity``.

    Two copies, or two items of one source, never share a bin: where no open bin is compatible one is opened.
    Only a source or cluster with more items than the bins that the split needs when nothing is asked of such
    keys can't be kept apart so: bins are opened for its items up to that number, and only then they go where
    the fewest of them are. A null source or cluster conflicts with nothing.
    Items go in the order of their size plus the capacity times the share of items with their most frequent key,
    as an item of a frequent source placed last finds every bin with room barred. Equal weights keep their order.
    """
    keys = [[k for k in (("source", s), ("copy", c)) if k[1] is not None] for s, c in zip(sources, copies, strict=True)]
    count = Counter(k for own in keys for k in own)
    limit = -(-sum(sizes) // capacity)
    hot = {k for k, n in count.items() if n > limit}
    by_weight = lambda keys: sorted(range(len(sizes)), key=lambda i: -_weight(sizes[i], keys[i], count, capacity, len(sizes)))
    if hot:
        free = [[k for k in own if k not in hot] for own in keys]
        limit = 1 + max(_fill(by_weight(free), sizes, free, capacity, set(), 0))
        hot = {k for k in hot if count[k] > limit}
    order = by_weight(keys)
    if hot:
        # items of large keys early, while the bins still have room for them; before them what no bin with one takes
        room = capacity - min(n for n, own in zip(sizes, keys, strict=True) if not hot.isdisjoint(own))
        order.sort(key=lambda i: 0 if sizes[i] > room else 2 if hot.isdisjoint(keys[i]) else 1)
    return _fill(order, sizes, keys, capacity, hot, limit)


def _weight(size: int, own: list[tuple], count: Counter, capacity: int, items: int) -> float:
    """How hard an item is to place: its size, and by how many items of its kind bins are barred to it."""
    return size + capacity * max((count[k] for k in own), default=0) / items


def _fill(order: list[int], sizes: list[int], keys: list[list[tuple]], capacity: int, hot: set[tuple], limit: int) -> list[int]:
    """The bins, where items of the ``hot`` keys share some once ``limit`` bins are open."""
    bins, out = Bins(capacity), [0] * len(sizes)
    for i in order:
        size, own = sizes[i], keys[i]
        place = bins.tightest(size, bins.with_more(own, 0))
        large = [k for k in own if k in hot]
        if place is None and large and len(bins.residuals) >= limit:
            strict = bins.with_more([k for k in own if k not in hot], 0)
            # bins with more than n items of a key get fewer with each n: the least n that leaves a bin is found by halving
            most = max(len(bins.levels.get(k, ())) for k in large)
            n = bisect_left(range(most), True, key=lambda n: bins.tightest(size, strict | bins.with_more(large, n)) is not None)
            place = bins.tightest(size, strict | bins.with_more(large, n))
        out[i] = bins.put(size, place, own)
    return out


def pack(items: DataFrame, ident: str, size: str, source: str, copy: str, *, capacity: int = CAPACITY, split: int = SPLIT) -> DataFrame:
    """(container, ``ident``, piece, ``size``) from one row per item.

    An item larger than ``capacity`` fills containers of its own but for its last piece; no other is split.
    Items of size 0 or null take no space and come out like others with size 0. No items give no rows.
    """
    splits = max(1, -(-items.count() // split))
    rows = pick(items, ident, size, source, copy).toDF("ident", "size", "source", "copy").withColumn("size", F.greatest(F.coalesce(F.col("size").cast("int"), F.lit(0)), F.lit(0)))
    kind = rows.schema["ident"].dataType.simpleString()
    last = F.when(F.col("size") > capacity, F.floor((F.col("size") - 1) / capacity)).otherwise(0).cast("int")
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).withColumn("size", F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).cast("int"))
    placed = pieces.withColumn("split", F.pmod(F.xxhash64("ident"), F.lit(splits)).cast("int"))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ident", "piece"], kind="stable")
        clean = [[None if pd.isna(x) else x for x in frame[c]] for c in ("source", "copy")]
        bins = best_fit(frame["size"].tolist(), *clean, capacity)
        frame["container"] = frame["split"].astype("int64") * (1 << 24) + bins
        return frame[["container", "ident", "piece", "size"]]

    out = placed.groupBy("split").applyInPandas(fill, f"container bigint, ident {kind}, piece int, size int")
    return out.withColumnsRenamed({"ident": ident, "size": size})


def pack_documents(documents: DataFrame, *, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(container, doc_id, piece, tokens) of every document; repeated rows count once.

    Copies are texts equal but for case and blanks. Texts are measured where they lie; only their sizes move.
    """
    plain = F.lower(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")))
    rows = pick(documents, "doc_id", "source", "text").select("doc_id", "source", F.when(F.col("text") != "", F.xxhash64(plain)).alias("copy"), "text")
    sized = count_tokens(rows, "text", vocabulary=vocabulary).dropDuplicates(["doc_id"])
    sized = cut(sized, "sized")
    return pack(sized, "doc_id", "tokens", "source", "copy", capacity=capacity)


def container_fill(packed: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """(containers, tokens, unused_share): how full the containers are."""
    each = packed.groupBy("container").agg(F.sum("tokens").alias("tokens"))
    total = each.agg(F.count("*").alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return total.select("containers", "tokens", F.round(1 - F.try_divide("tokens", F.col("containers") * capacity), 6).alias("unused_share"))
