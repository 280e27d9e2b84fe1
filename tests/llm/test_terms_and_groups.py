"""Term frequencies and groups against brute force, and their edge cases."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lipimala.llm.components import connected_components, same_shape_groups
from lipimala.llm.term_frequency import LastSeen, mark_terms, term_frequency, useless_terms

TERMS = "field string, term string, record string, n bigint"


def test_counts_equal_sets_of_records(spark):
    rng = random.Random(1)
    rows = [("f", rng.choice("aaaaab") + str(rng.randrange(3)), f"r{rng.randrange(20)}", rng.randrange(1, 4)) for _ in range(600)]
    want = defaultdict(lambda: [0, set()])
    for f, t, r, n in rows:
        want[f, t][0] += n
        want[f, t][1].add(r)
    for salts, chunk, held in ((1, 1 << 18, 1 << 20), (7, 16, 2), (2, 1, 1)):  # chunks and counters end anywhere
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", min(chunk, 10_000))
        try:
            counts, totals = term_frequency(spark.createDataFrame(rows, TERMS), salts=salts, chunk=chunk, held_terms=held)
            got = {(r.field, r.term): (r.frequency, r.records) for r in counts.collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == {k: (n, len(s)) for k, (n, s) in want.items()}
        assert [tuple(r) for r in totals.collect()] == [("f", 20)]


def test_a_record_that_goes_on_in_the_next_chunk_counts_once():
    counter = LastSeen()
    column = lambda *x: pa.array(x, pa.string())
    for terms, records in ((("a", "b", "a"), ("r", "r", "s")), (("a", "b"), ("s", "s")), (("a", "a"), ("s", "t"))):
        counter.feed(column(*["f"] * len(terms)), column(*terms), column(*records), np.ones(len(terms), np.int64))
        assert counter.drain(False) == ([] if records == ("s", "s") else [("f", "b", 1, 1)])
    assert counter.drain(True) == [("f", "a", 5, 3)]


def test_nulls_count_as_stated(spark):
    rows = [("f", None, "r", 5), ("f", "a", None, 3), ("f", "a", "r", None), ("f", "b", None, None)]
    got = {r.term: (r.frequency, r.records) for r in term_frequency(spark.createDataFrame(rows, TERMS))[0].collect()}
    assert got == {"a": (3, 1), "b": (0, 0)}


def test_marks_at_their_borders(spark):
    counts = spark.createDataFrame([("f", "five", 5, 2), ("f", "four", 4, 2), ("f", "one record", 50, 1), ("f", "half", 9, 5), ("f", "more", 9, 6)], "field string, term string, frequency bigint, records bigint")
    totals = spark.createDataFrame([("f", 10)], "field string, all_records bigint")
    assert {r.term: r.mark for r in mark_terms(counts, totals).collect()} == {"five": None, "four": "rare", "one record": "rare", "half": None, "more": "common"}


def _tables(spark, occurrences=(), pages=(), stats=()):
    return (
        spark.createDataFrame(list(occurrences), "book string, page int, line int, word int, position int, shape_id bigint, n string, SHAPE_ID string"),
        spark.createDataFrame(list(pages), "book string, page int, unmapped map<string,bigint>, term string, converted_at string"),
        spark.createDataFrame(list(stats), "book string, glyph string, count bigint, frequency int"),
    )


def test_useless_terms_with_repeated_rows_marks_and_clashing_columns(spark):
    occ = [("b", p, 1, w, 1, 7, "x", "y") for p in (1, 2, 3) for w in (1, 2)] * 2 + [("b", 1, 2, 1, 1, None, "x", "y"), ("b", 4, 1, 1, 1, 8, None, None)]
    pages = [("b", 1, {"⟦k⟧": 3, "k": 2}, "t", "late"), ("b", 1, {"⟦k⟧": 3, "k": 2}, "t", "later"), ("b", 2, {"k": 1}, None, None), ("b", 3, None, None, None), ("b", 4, {}, None, None), ("b", 5, None, None, None)]
    stats = [("b", "g", 9, 1), ("c", "g", None, 1), ("d", "g", 0, 1), ("b", None, 3, 1), ("b", "h", None, 1)]
    got = {tuple(r) for r in useless_terms(*_tables(spark, occ, pages, stats)).collect()}
    assert got == {("shape_id", "7", "common"), ("shape_id", "8", "rare"), ("glyph", "g", "rare")}  # no book uses h


def test_no_rows_no_terms(spark):
    assert useless_terms(*_tables(spark)).count() == 0


def _brute(links):
    near = defaultdict(set)
    for a, b in links:
        if a is not None and b is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    out, seen = set(), set()
    for start in sorted(near):
        if start in seen:
            continue
        todo, group = [start], {start}
        while todo:
            for y in near[todo.pop()] - group:
                group.add(y)
                todo.append(y)
        seen |= group
        out |= {(min(group), x) for x in group}
    return out


@pytest.mark.parametrize("links", [
    [(i, i + 1) for i in range(40)],
    [(i + 1, i) for i in range(0, 30, 2)],
    [(100, i) for i in range(30)] + [(200, 100)],
    [(random.Random(3).randrange(60), random.Random(i).randrange(60)) for i in range(50)],
    [(1, 2), (2, 1), (1, 2), (3, 3), (None, 4), (4, None), (9, 8)],
    [],
])
def test_groups_equal_a_walk_over_the_links(spark, links):
    got = [tuple(r) for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()]
    assert len(got) == len(set(got))
    assert set(got) == _brute(links)


def test_same_mentions(spark):
    atlas = spark.createDataFrame([("b", 1, [2, None, 1], "x"), ("c", 3, [2, 99], "x"), ("c", 3, [2, 99], "x"), ("c", 99, [4], None), ("d", 5, None, None), ("d", 6, [], None), (None, None, [1], None)], "book string, shape_id bigint, same array<bigint>, other string")
    catalog = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6)] + [(None,)], "shape_id bigint")
    assert {tuple(r) for r in same_shape_groups(atlas, catalog).collect()} == {(1, 1), (1, 2), (1, 3)}
