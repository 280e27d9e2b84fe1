"""Frequency of every distinct term, and in how many records it occurs.

Last-seen counters. The rows of a term are hash-partitioned with a salt made of the record and read in the
order of the records; a counter keeps for each term its occurrences, its records and the record seen last,
and a record counts when it differs from that one. No term ever holds a set of records. All rows of one
(term, record) lie in one partition, so the counters of the partitions are added: a hot term costs every
partition one row, a hot record is spread by its terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lipimala.runtime import cut, pick

#: Parts that the terms of a record are spread over.
SALTS = 16
#: Rows counted at once, and terms held by a counter before those whose record is over are handed on.
CHUNK, TERMS = 1 << 18, 1 << 20


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it; the first one always does."""
    if pa.types.is_struct(column.type):
        parts = [column.is_null(), *(column.field(i) for i in range(column.type.num_fields))]
        return np.logical_or.reduce([_changes(p) for p in parts])
    codes = np.asarray(column.dictionary_encode(null_encoding="encode").indices)
    return np.r_[True, codes[1:] != codes[:-1]] if len(codes) else np.zeros(0, bool)


class LastSeen:
    """Occurrences, records and last record of every term, fed with rows in the order of their records."""

    def __init__(self) -> None:
        self.codes: dict[tuple, int] = {}
        self.occurrences, self.records, self.last = (np.zeros(0, np.int64) for _ in range(3))
        self.record, self.running = None, -1  # the record seen last of all, and its running number

    def feed(self, fields: pa.Array, terms: pa.Array, records: pa.Array, n: np.ndarray) -> np.ndarray:
        """Counts the rows; returns where a record begins."""
        new_record = _changes(records)
        absent = np.asarray(records.is_null())
        if len(new_record) and not absent[0] and records[0].as_py() == self.record:
            new_record[0] = False
        new_record &= ~absent
        running = self.running + np.cumsum(new_record)
        if len(absent) and not absent[-1]:
            self.record, self.running = records[len(records) - 1].as_py(), int(running[-1])
        self._count(fields, terms, np.where(absent, -1, running), n)
        return new_record

    def _count(self, fields: pa.Array, terms: pa.Array, record: np.ndarray, n: np.ndarray) -> None:
        there = ~np.asarray(terms.is_null())
        kinds, names = fields.dictionary_encode(), terms.dictionary_encode()
        if not there.any():
            return
        wide = len(names.dictionary)
        both = np.asarray(kinds.indices.fill_null(0), np.int64)[there] * wide + np.asarray(names.indices.fill_null(0), np.int64)[there]
        distinct, inverse = np.unique(both, return_inverse=True)
        kind, name = kinds.dictionary.to_pylist(), names.dictionary.to_pylist()
        code = np.array([self.codes.setdefault((kind[x // wide], name[x % wide]), len(self.codes)) for x in distinct.tolist()], np.int64)[inverse]
        more = len(self.codes) - len(self.last)
        self.occurrences, self.records, self.last = np.r_[self.occurrences, np.zeros(more, np.int64)], np.r_[self.records, np.zeros(more, np.int64)], np.r_[self.last, np.full(more, -2, np.int64)]
        record, n = record[there], n[there]
        np.add.at(self.occurrences, code, n)
        seen = np.flatnonzero(record >= 0)
        order = seen[np.argsort(code[seen], kind="stable")]  # each term's rows stay in the order of their records
        term, at = code[order], record[order]
        if not len(term):
            return
        first = np.r_[True, term[1:] != term[:-1]]
        before = np.r_[-2, at[:-1]]
        before[first] = self.last[term[first]]
        np.add.at(self.records, term, at != before)
        end = np.r_[first[1:], True]
        self.last[term[end]] = at[end]

    def drain(self, every: bool) -> list[tuple]:
        """(field, term, occurrences, records) of all terms, or of those that the record at hand has not met."""
        go = np.full(len(self.last), True) if every else self.last != self.running
        names = list(self.codes)
        out = [(*names[i], int(self.occurrences[i]), int(self.records[i])) for i in np.flatnonzero(go)]
        keep = np.flatnonzero(~go)
        self.codes = {names[i]: k for k, i in enumerate(keep.tolist())}
        self.occurrences, self.records, self.last = self.occurrences[keep], self.records[keep], self.last[keep]
        return out


def _counters(chunk: int, held_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, held, rows, schema = LastSeen(), [], 0, None

        def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
            field, term, record, n = (table[c].combine_chunks() for c in ("field", "term", "record", "n"))
            begins = counter.feed(field, term, record, np.asarray(n, np.int64))
            at = pa.array(np.flatnonzero(begins))
            blank = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([field.take(at), pa.nulls(len(at), pa.string()), blank, blank, record.take(at)], schema=schema)

        def drained(every: bool) -> Iterator[pa.RecordBatch]:
            found = counter.drain(every)
            for i in range(0, len(found), 1 << 16):
                columns = [pa.array(x, t) for x, t in zip(zip(*found[i : i + (1 << 16)], strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(columns[0]), schema.field("record").type)], schema=schema)

        for batch in batches:
            if schema is None:
                schema = pa.schema([("field", pa.string()), ("term", pa.string()), ("frequency", pa.int64()), ("records", pa.int64()), ("record", batch.schema.field("record").type)])
            held.append(batch)
            rows += batch.num_rows
            if rows >= chunk:
                yield from work(pa.Table.from_batches(held))
                held, rows = [], 0
                if len(counter.codes) > held_terms:
                    yield from drained(False)
        if held and rows:
            yield from work(pa.Table.from_batches(held))
        if schema is not None:
            yield from drained(True)

    return run


def term_frequency(terms: DataFrame, *, salts: int = SALTS, placed: bool = False, chunk: int = CHUNK, held_terms: int = TERMS) -> tuple[DataFrame, DataFrame]:
    """(counts, totals) from raw rows (field, term, record, n): counts has field, term, frequency and records,
    totals has field and all_records, the number of distinct records of the field.

    A row with a null term is no term but makes its record one of the field's records. ``n`` null counts as
    0. A row whose ``record`` is null adds to the frequency and is in no record. Rows of one (term, record)
    may come in any number and order; ``placed`` states that they lie in one partition already. The order of
    the records is within partitions only: nothing is sorted across them.
    """
    rows = terms.select("field", F.col("term").cast("string").alias("term"), "record", F.coalesce(F.col("n").cast("bigint"), F.lit(0)).alias("n"))
    if not placed:
        rows = rows.repartition("field", "record", F.pmod(F.xxhash64("term"), F.lit(salts)))
    kind = rows.schema["record"].dataType.simpleString()
    counted = rows.sortWithinPartitions("field", "record").mapInArrow(_counters(chunk, held_terms), f"field string, term string, frequency bigint, records bigint, record {kind}")
    parts = cut(counted, "counters")
    counts = parts.where("term is not null").groupBy("field", "term").agg(F.sum("frequency").alias("frequency"), F.sum("records").alias("records"))
    totals = parts.where("term is null").select("field", "record").distinct().groupBy("field").agg(F.count("*").alias("all_records"))
    return counts, totals


def mark_terms(counts: DataFrame, totals: DataFrame, *, least: int = 5, most_share: float = 0.5) -> DataFrame:
    """``counts`` with mark ``rare``, ``common`` or null.

    rare: frequency below ``least`` or in one record at most; common: in more than ``most_share`` of all
    records. ``totals`` has (field, all_records), one row per field, which bounds its size.
    """
    rare = (F.col("frequency") < least) | (F.col("records") <= 1)
    common = F.col("records") > F.col("all_records") * most_share
    marked = counts.join(F.broadcast(totals), "field").withColumn("mark", F.when(rare, "rare").when(common, "common"))
    return marked.select("field", "term", "frequency", "records", "mark")


def _shapes(occurrences: DataFrame) -> DataFrame:
    key = ["book", "page", "line", "word", "position"]
    rows = pick(occurrences, *key, "shape_id")
    # one shuffle serves the removal of repeated rows, which agree in their shape, and the counters
    rows = rows.withColumn("part", F.pmod(F.xxhash64("shape_id"), F.lit(SALTS)))
    once = rows.repartition("book", "page", "part").dropDuplicates([*key, "part"])
    return once.select(F.lit("shape_id").alias("field"), F.col("shape_id").cast("string").alias("term"), F.struct("book", "page").alias("record"), F.lit(1).cast("bigint").alias("n"))


def _unmapped(pages: DataFrame) -> DataFrame:
    once = pick(pages, "book", "page", "unmapped").dropDuplicates(["book", "page"])
    rows = once.select("book", "page", F.explode_outer("unmapped").alias("term", "n"))
    return rows.select(F.lit("unmapped").alias("field"), F.translate("term", "⟦⟧", "").alias("term"), F.struct("book", "page").alias("record"), "n")


def _glyphs(stats: DataFrame) -> DataFrame:
    once = pick(stats, "book", "glyph", "count").dropDuplicates(["book", "glyph"])
    book = F.struct("book", F.lit(0).alias("page"))
    used = F.when(F.coalesce("count", F.lit(0)) != 0, book)
    both = F.array(F.struct(F.col("glyph").alias("term"), used.alias("record"), F.col("count").cast("bigint").alias("n")), F.struct(F.lit(None).cast("string").alias("term"), book.alias("record"), F.lit(0).cast("bigint").alias("n")))
    return once.select(F.lit("glyph").alias("field"), F.explode(both).alias("x")).select("field", "x.term", "x.record", "x.n")


def corpus_terms(occurrences: DataFrame, pages: DataFrame, stats: DataFrame) -> DataFrame:
    """Frequency, records and mark of every shape, unmapped glyph sequence and glyph.

    Repeated rows count once. An unmapped key means the same with and without its marks. A glyph row with
    a null or zero count is no record of its glyph, and a glyph that no book uses is no term of the
    collection. Empty tables give no rows.
    """
    small = _unmapped(pages).unionByName(_glyphs(stats)).repartition("field", "record", F.pmod(F.xxhash64("term"), F.lit(SALTS)))
    counts, totals = term_frequency(_shapes(occurrences).unionByName(small), placed=True)
    return mark_terms(counts, totals).where("field <> 'glyph' or records > 0")


def useless_terms(occurrences: DataFrame, pages: DataFrame, stats: DataFrame) -> DataFrame:
    """(field, term, mark) of the terms too rare or too common."""
    return corpus_terms(occurrences, pages, stats).where("mark is not null").select("field", "term", "mark")
