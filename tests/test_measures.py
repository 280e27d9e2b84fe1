"""Counts of hot keys, matching, quality, mapping comparison, alphabet statistics."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lipimala.operators import alphabet as A
from lipimala.operators import compare as C
from lipimala.operators import match as M
from lipimala.operators import quality as Q
from lipimala.operators.dense_counts import atlas_counts, dense_counts, wrong_counts
from lipimala.operators.transcode import Mapping
from lipimala import runtime
from lipimala.runtime import hot_join, once, pick, shared_dir, small

OCC = "book string, page int, line int, word int, position int, shape_id bigint, n string, Book string"
ATLAS = "book string, shape_id bigint, count bigint, occurrences string"
BOX = "struct<x0 double,y0 double,x1 double,y1 double>"


def test_dense_counts_of_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", None]), 5 if rng.random() < 0.6 else rng.choice([-7, 0, 511, 512, 10**12, None])) for _ in range(3000)]
    got = {(r.grp, r.ident): r.n for r in dense_counts(spark.createDataFrame(rows, "g string, i bigint"), F.col("g"), F.col("i")).collect()}
    assert got == Counter(r for r in rows if r[1] is not None)


def test_wrong_counts(spark):
    occ = [("b", 1, 1, w, 1, 7, "n", "B") for w in range(3)] * 2 + [("b", 1, 2, 1, 1, None, None, None), ("c", 1, 1, 1, 1, 8, None, None)]
    atlas = [("b", 7, 3, "x"), ("b", 7, 3, "x"), ("c", 8, None, None), ("c", 8, None, None), ("d", 9, 1, None), ("d", 10, 0, None), (None, None, 4, None), ("b", 8, 1, None)]
    occ, atlas = spark.createDataFrame(occ, OCC), spark.createDataFrame(atlas, ATLAS)
    assert {tuple(r) for r in wrong_counts(atlas, occ).collect()} == {("c", 8), ("d", 9), (None, None), ("b", 8)}
    assert {r.occurrences for r in atlas_counts(atlas, occ).where("shape_id = 7").collect()} == {3}
    assert wrong_counts(atlas.limit(0), occ.limit(0)).count() == 0


def test_hot_join_loses_nothing(spark):
    left = spark.createDataFrame([(1, i) for i in range(3000)] + [(2, 0), (None, 1), (9, 9)], "k int, v int")
    right = spark.createDataFrame([(1, 3000, "hot"), (2, 1, "cold"), (3, 0, "none")], "k int, n int, w string")
    assert Counter(r.w for r in hot_join(left, right, "k", "n", 3003.0).collect()) == {"hot": 3000, "cold": 1}


def test_once_moves_repeated_keys_only(spark, monkeypatch):
    rows = [(1, "a"), (2, "b"), (2, "b"), (None, "c"), (None, "c"), (3, None)]
    df = spark.createDataFrame(rows, "k int, v string")
    for limit in (200_000, 0):  # also where the repeated keys are too many to broadcast
        monkeypatch.setattr(runtime, "small", lambda d, limit=limit: small(d, limit))
        assert Counter(map(tuple, once(df, "k").collect())) == Counter({(1, "a"): 1, (2, "b"): 1, (None, "c"): 1, (3, None): 1})
    assert once(df.where("k = 1"), "k").count() == 1


def test_small_counts_rows_and_bytes(spark):
    df = spark.range(10).selectExpr("id", "repeat('x', 100) as t")
    assert small(df, 10) and not small(df, 9) and not small(df, 10, 500) and small(df.limit(0), 0)


def test_a_cluster_must_name_its_shared_folder(spark):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_pick_is_exact(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("x", "X", "y.z")
    assert tuple(pick(df, "x", "X", "y.z").first()) == (1, 2, 3) and pick(df, "Y.Z").first()[0] == 3
    with pytest.raises(ValueError, match="no column"):
        pick(df, "w")


# --- matching ----------------------------------------------------------------------------------------


def _iou(a, b):
    wide, high = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0, wide) * max(0, high)
    joint = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / joint if joint > 0 else 0


def test_best_matches_equal_all_pairs(spark):
    rng = random.Random(3)

    def boxes(n):
        return [(rng.randrange(2), i, (x := float(rng.randrange(150)), y := float(rng.randrange(150)), x + rng.randrange(90), y + rng.randrange(40))) for i in range(n)]

    left, right = boxes(60), boxes(60)
    words = spark.createDataFrame([*left, (0, 99, None)], f"page int, w int, box {BOX}")
    ocr = spark.createDataFrame([*right, (0, 99, None)], f"page int, o int, ocr_box {BOX}")
    for least in (0.01, 0.3):
        want = {}
        for p, w, a in left:
            best = max(((_iou(a, b), -o) for q, o, b in right if q == p), default=(0, 0))
            if best[0] >= least:
                want[w] = -best[1]
        assert {r.w: r.o for r in M.best_matches(words, ocr, ["page"], ["w"], "o", least=least).collect()} == want


def test_observations_do_not_fall_back(spark):
    box = (0.0, 0.0, 10.0, 10.0)
    words = spark.createDataFrame([(1, 1, box)], f"page int, w int, box {BOX}")
    ocr = spark.createDataFrame([(1, 1, "abc", box), (1, 2, "తోతొ", (0.0, 0.0, 10.0, 9.0))], f"page int, o int, ocr_text string, ocr_box {BOX}")
    assert M.observations(words, ocr, ["page"], ["w"], "o").count() == 0
    assert M.compare_words(words, ocr, ["page"], ["w"], "o").first().ocr_text == "abc"


# --- quality -----------------------------------------------------------------------------------------


def test_page_quality(spark):
    rows = [(1, "మ", "మ", 90.0), (1, "వ", "న", 50.0), (1, "⟦x⟧", "క", 40.0), (1, "ల", None, None), (2, "ల", None, None)]
    rows = spark.createDataFrame(rows, "page int, converted string, ocr string, confidence double").withColumn("book", F.lit("b"))
    got = {r.page: r for r in Q.rates(Q.with_total(Q.page_quality(rows, ["book", "page"]), ["book"])).collect()}
    assert (got[1].words, got[1].matched, got[1].disagreements, got[1].unresolved, got[1].agreement_rate) == (4, 3, 2, 1, 1 / 3)
    assert (got[2].agreement_rate, got[2].mean_confidence_agreeing, got[0].words, got[0].mean_confidence_disagreeing) == (1.0, 0.0, 5, 45.0)


def test_confusions(spark):
    rows = spark.createDataFrame([("కటక", "కరక"), ("కటక", "కరక"), ("కక", "కరక"), ("క", "క"), (None, "క")], "ocr string, converted string")
    assert {tuple(r) for r in Q.confusions(rows).collect()} == {("ట", "ర", 2)}


def test_ground_truth(spark):
    pages = spark.createDataFrame([(6, "అ ఆ ఇ", "అ ఆ ఈ", "అ ఇ"), (7, "", "x", "")], "page int, r string, c string, o string")
    got = {r.page: r for r in Q.ground_truth(pages, "r", "c", "o").collect()}
    assert (got[6].converted_wer, got[6].converted_cer, got[6].ocr_wer, got[6].ocr_cer) == (1 / 3, 1 / 5, 1 / 3, 2 / 5)
    assert (got[7].converted_wer, got[7].converted_word_errors) == (0.0, 1)
    total = Q.overall(Q.ground_truth(pages, "r", "c", "o")).first()
    assert (total.reference_words, total.converted_wer) == (3, 2 / 3)


def test_word_changes(spark):
    rows = spark.createDataFrame([("a b c", "a x c"), ("a b c", "a x c"), ("a", "a b"), (None, "a")], "o string, n string")
    assert {tuple(r) for r in Q.word_changes(rows, "o", "n").collect()} == {("b", "x", 2), ("", "b", 1), ("", "a", 1)}


# --- comparison --------------------------------------------------------------------------------------


def test_differences_and_verdicts(spark):
    make = lambda d: Mapping(spark.createDataFrame(list(d.items()), "glyphs string, unicode string"))
    words = spark.createDataFrame([(1, "=∞", "మ"), (2, "=∞", "వు"), (3, "=∞", None), (4, "#", "క"), (5, "q", "ల"), (6, "w", "స")], "page int, g string, ocr string")
    both = C.convert_both(words, "g", make({"=∞": "మ", "#": "న", "w": "స"}), make({"=∞": "వు", "#": "న", "q": "ల", "w": "హ"}))
    found = C.differences(both, "g", "ocr", F.col("page"))
    assert {r.glyphs: (r["count"], r.candidate_votes, r.reference_votes, r["first"], r.verdict) for r in found.collect()} == {"=∞": (3, 1, 1, 1, "human"), "q": (1, 0, 1, 5, "candidate_gap"), "w": (1, 1, 0, 6, "old_wrong")}
    assert {tuple(r) for r in C.summary(found).collect()} == {("human", 1, 3), ("candidate_gap", 1, 1), ("old_wrong", 1, 1), ("new_wrong", 0, 0)}


# --- alphabet ----------------------------------------------------------------------------------------


def test_alphabet_stats(spark):
    rows = spark.createDataFrame([("b", 1, 98), ("b", 2, 1), ("b", 3, 1), ("b", 4, 0)], "book string, shape_id int, count bigint")
    r = A.alphabet_stats(rows, ["book"]).first()
    assert (r.shapes, r.singletons, r.shapes_for_coverage, r.occurrences) == (3, 2, 2, 100)


def test_samples_and_readings(spark):
    rows = spark.createDataFrame([(1, i) for i in range(10)] + [(2, 0)], "k int, i int")
    assert sorted(r.i for r in A.systematic_sample(rows, ["k"], ["i"], 4).where("k = 1").collect()) == [0, 3, 6, 9]
    assert A.member_sample(rows, ["k"], ["i"], 3).groupBy("k").count().where("count > 3").count() == 0
    reads = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "", 3), (1, "", 4), (1, "", 5), (2, None, 1)], "k int, t string, seq int")
    assert {tuple(r) for r in A.majority(reads, ["k"], "t", "seq").collect()} == {(1, "b", 1), (2, "", 0)}
    words = spark.createDataFrame([("b", "xy", 1), ("b", "xy", 2), ("b", "xxz", 3), ("b", "", 4)], "book string, glyphs string, seq int")
    assert {r.glyph: (r["count"], list(r.words)) for r in A.glyph_stats(words, ["book"]).collect()} == {"x": (4, ["xy", "xxz"]), "y": (2, ["xy"]), "z": (1, ["xxz"])}
