"""Counts per key when a handful of keys own most rows.

Dense accumulator arrays: rows are spread over equal splits by a key that has no hot value, each split
encodes its (group, id) keys and adds them up with ``numpy.bincount`` into array blocks, and the arrays of
a block are added whole in the reduction, which unpacks the sum once. A hot key costs every split one slot,
so it can hold back no task: what reaches the reduction is at most one array per block and split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lipimala.runtime import pick

#: Ids of one block; a block travels as the slots between its first and last used one.
BLOCK = 512


def _add_up(codes: list[np.ndarray], ids: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dictionary-encode the (group code, id) keys and add their numbers into one dense array."""
    keys = np.rec.fromarrays([np.concatenate(codes), np.concatenate(ids)], names="code,id")
    order = np.lexsort((keys.id, keys.code))
    code, ident = keys.code[order], keys.id[order]
    new = np.ones(len(order), bool)
    new[1:] = (code[1:] != code[:-1]) | (ident[1:] != ident[:-1])
    sums = np.bincount(np.cumsum(new) - 1, weights=np.concatenate(n)[order]).astype(np.int64)
    return code[new], ident[new], sums


def _blocks(batches: Iterator[pa.RecordBatch], block: int, flush: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """One partition's rows as (grp, block, first, counts), one row per block touched."""
    names: dict[str | None, int] = {}
    held: tuple[list, list, list] = ([], [], [])
    rows = 0
    for batch in batches:
        groups = batch.column(0).dictionary_encode()
        to = np.array([names.setdefault(x, len(names)) for x in [*groups.dictionary.to_pylist(), None]], np.int64)
        held[0].append(to[np.asarray(groups.indices.fill_null(len(groups.dictionary)), np.int64)])
        held[1].append(np.asarray(batch.column(1), np.int64))
        held[2].append(np.ones(batch.num_rows, np.int64))
        rows += batch.num_rows
        if rows > flush:
            held = tuple([x] for x in _add_up(*held))
            rows = 0
    if not held[0] or not sum(map(len, held[0])):
        return
    code, ident, sums = _add_up(*held)
    label, place = list(names), ident // block
    start = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (place[1:] != place[:-1])])
    end = np.r_[start[1:], len(code)]
    schema = pa.schema([("grp", pa.string()), ("block", pa.int64()), ("first", pa.int32()), ("counts", pa.list_(pa.int64()))])
    out = []
    for i, j in zip(start, end, strict=True):
        counts = np.zeros(ident[j - 1] - ident[i] + 1, np.int64)
        counts[ident[i:j] - ident[i]] = sums[i:j]
        out.append((label[code[i]], int(place[i]), int(ident[i] - place[i] * block), counts))
        if len(out) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(map(list, zip(*out)), schema, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(map(list, zip(*out)), schema, strict=True)], schema=schema)


def _summed(batches: Iterator[pa.RecordBatch], block: int, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Array blocks sorted by (grp, block): adds the arrays of each block and unpacks the sums."""
    names = ["grp", "ident", "n"]
    carried: tuple | None = None  # the block that may go on in the next rows, and its sums so far

    def unpacked(keys: list[tuple], sums: np.ndarray) -> pa.RecordBatch:
        at, slot = np.nonzero(sums)
        groups = pa.array([g for g, _ in keys], pa.string()).take(pa.array(at))
        first = np.array([b for _, b in keys], np.int64) * block
        return pa.RecordBatch.from_arrays([groups, pa.array(first[at] + slot), pa.array(sums[at, slot])], names=names)

    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            part = batch.slice(begin, rows)
            keys = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
            if carried is not None:
                keys.insert(0, carried[0])
            run = np.cumsum([False, *(x != y for x, y in zip(keys[1:], keys[:-1], strict=True))])
            own = run[len(keys) - part.num_rows :]
            arrays = part.column(3)
            sizes = np.asarray(arrays.value_lengths(), np.int64)
            ends = np.cumsum(sizes)
            inside = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
            slots = np.repeat(own * block + np.asarray(part.column(2), np.int64), sizes) + inside
            sums = np.zeros((run[-1] + 1) * block, np.int64)
            np.add.at(sums, slots, np.asarray(arrays.flatten()))
            sums = sums.reshape(-1, block)
            if carried is not None:
                sums[0] += carried[1]
            distinct = [keys[i] for i in np.flatnonzero(np.r_[True, run[1:] != run[:-1]])]
            carried = distinct[-1], sums[-1].copy()
            if len(distinct) > 1:
                yield unpacked(distinct[:-1], sums[:-1])
    if carried is not None:
        yield unpacked([carried[0]], carried[1][None])


def dense_counts(rows: DataFrame, group: Column, ident: Column, *, block: int = BLOCK) -> DataFrame:
    """Rows per (``grp``, ``ident``) as columns grp string, ident bigint, n bigint.

    ``rows`` should already be spread evenly (for instance hash-partitioned by a page or row key). Rows
    with a null ``ident`` are no occurrence of anything and are left out; a null group is a group of its
    own; an empty input gives an empty result. Arrays travel and are added whole; what a key's block costs
    the reduction is one array of ``block`` numbers per split.
    """
    keyed = rows.select(group.cast("string").alias("grp"), ident.cast("bigint").alias("ident")).where("ident is not null")
    arrays = keyed.mapInArrow(lambda it: _blocks(it, block), "grp string, block bigint, first int, counts array<bigint>")
    placed = arrays.repartition("grp", "block").sortWithinPartitions("grp", "block")
    return placed.mapInArrow(lambda it: _summed(it, block), "grp string, ident bigint, n bigint")


def occurrence_counts(occurrences: DataFrame) -> DataFrame:
    """True number of occurrences of every (book, shape_id), repeated deliveries counted once.

    The delivery key is hashed by page, never by shape, so the split sizes do not depend on how often a
    shape is used.
    """
    key = ["book", "page", "line", "word", "position"]
    once = pick(occurrences, *key, "shape_id").repartition("book", "page").dropDuplicates(key)
    return dense_counts(once, F.col("book"), F.col("shape_id")).select(F.col("grp").alias("book"), F.col("ident").alias("shape_id"), F.col("n").alias("occurrences"))


def atlas_counts(atlas: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Every atlas row once with its stated ``count`` and the true ``occurrences`` (0 where there are none).

    A row with a null book or shape_id names nothing, so nothing occurs; an empty atlas gives no rows. Other
    columns of the tables, of whatever name, are not looked at.
    """
    stated = pick(atlas, "book", "shape_id", "count").dropDuplicates()
    true = occurrence_counts(occurrences)
    return stated.join(true, ["book", "shape_id"], "left").withColumn("occurrences", F.coalesce("occurrences", F.lit(0)))


def wrong_counts(atlas: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Keys (book, shape_id) of atlas rows whose count is null or not the true one."""
    wrong = atlas_counts(atlas, occurrences).where(F.col("count").isNull() | (F.col("count") != F.col("occurrences")))
    return wrong.select("book", "shape_id").distinct()
