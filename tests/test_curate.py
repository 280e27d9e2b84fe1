"""Learning, confirmations, recipes, page layout, shapes, sources and streams."""

import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lipimala.functions import bitmaps as B
from lipimala.operators import learn as L
from lipimala.operators import probe as P
from lipimala.operators import recipes as R
from lipimala.operators import scan_layout as SL
from lipimala.operators import shape_index as SI
from lipimala.operators import solver as V
from lipimala.operators.transcode import Mapping
from lipimala.plans import curate_queries
from lipimala.sources import outputs, pages, tsv
from lipimala.streaming import ingest

# --- solver ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("segments, target, want", [
    ([("=", "వ"), ("X", None)], "వుల", ["ుల"]),
    ([("X", None), ("#", "న")], "కన", ["క"]),
    ([("X", None), ("#", "న"), ("X", None)], "కనక", []),  # two gaps are no single gap
    ([("#", "న")], "న", []),
    ([("X", None), ("#", "న")], "కల", []),
])
def test_candidates(segments, target, want):
    assert V.candidates(segments, target) == want


def test_several_gaps_and_widening():
    assert V.solve([("X", None), ("#", "న"), ("Y", None)], "కనల") == [{"X": "క", "Y": "ల"}]
    assert V.solve([("X", None), ("#", "న"), ("X", None)], "కనక") == [{"X": "క"}]
    assert V.solve_confirmed([("#", "న"), ("x", None), ("y", "క")], "నక") == {"xy": "క"}  # a gap for nothing widens right
    assert V.solve_confirmed([("x", None), ("y", "క")], "నల") is None
    assert V.absorbed([("#", "న"), ("x", None), ("y", "క")], ["xy"]) == "క"
    with pytest.raises(ValueError):
        V.context([("#", "న")])


@pytest.mark.parametrize("line, want", [("a⟦=⟧b = క", ("a⟦=⟧b", "క")), ("a\tక", ("a", "క")), ("a = b\tక", ("a = b", "క")), ("only", None), ("", None)])
def test_confirmation_lines(line, want):
    assert V.parse_confirmation(line) == want


# --- learning ----------------------------------------------------------------------------------------


def _entries(spark, table):
    return spark.createDataFrame([(k, v, None, "") for k, v in table.items()], L.ENTRIES)


def test_learning_opens_further_words(spark):
    state = L.State(_entries(spark, {"a": "క", "b": "గ"}), L.empty_pending(spark))
    words = [(1, 1, "ax", "కల"), (2, 1, "bx", "గల"), (3, 1, "xy", "లమ"), (4, 2, "axy", "కలమ"), (5, 2, "z", "abc"), (6, 2, "aw", "కన"), (7, 2, "aw", "కన")]
    observed = L.observed_words(spark.createDataFrame(words, "seq bigint, page int, glyphs string, ocr_text string"))
    learned, after = L.learn_until_stable(observed, state)
    assert {(r.glyphs, r.unicode) for r in learned.collect()} == {("x", "ల"), ("xy", "లమ")}
    assert [(r.glyphs, r["count"], len(r.contexts)) for r in after.pending.collect()] == [("w", 2, 1)]
    by_page, _ = L.learn_pages(observed, state, [1, 2])
    assert {r.glyphs for r in by_page.collect()} == {"x"}  # "y" has one context, as "x" is known on page 2


def test_conflicting_proposals_wait(spark):
    votes = spark.createDataFrame([("x", "ల", "a|", 1, "w", 1), ("x", "ల", "b|", 1, "w", 2), ("x", "మ", "c|", 1, "w", 3)], "glyphs string, unicode string, context string, page int, word string, seq int")
    accepted, state = L.accept(L.State(_entries(spark, {}), L.vote(L.empty_pending(spark), votes)))
    assert accepted.count() == 0 and state.pending.count() == 2
    more = L.vote(state.pending, votes.limit(1))
    assert {(r.unicode, r["count"], len(r.contexts)) for r in more.collect()} == {("ల", 3, 2), ("మ", 1, 1)}


def test_confirmations(spark):
    words = spark.createDataFrame([(1, 1, "ax"), (2, 1, "xy"), (3, 2, "ab")], "seq bigint, page int, glyphs string")
    asked = spark.createDataFrame([("క⟦x⟧", "కల"), ("⟦xy⟧", "లమ"), ("కగ", "కమ"), ("కగ", "కగ"), ("⟦q⟧", "న"), ("⟦w⟧", "వ")], "shown string, correct string")
    state = L.State(_entries(spark, {"a": "క", "b": "గ"}), L.empty_pending(spark))
    results, after = L.confirm(asked, words, state)
    got = {(r.shown, r.correct): r.status for r in results.collect()}
    assert got[("క⟦x⟧", "కల")] == "added" and got[("కగ", "కగ")] == "already correct" and got[("⟦q⟧", "న")] == "not found"
    assert got[("కగ", "కమ")].startswith("correction") and got[("⟦xy⟧", "లమ")] in ("added", "unsolved")
    assert {r.glyphs for r in after.entries.collect()} >= {"a", "b", "x"}


def test_suspicions(spark):
    rows = spark.createDataFrame([("a", "ఖ", "accepted"), ("b", "ఘ", "rejected")], "glyphs string, suggested string, status string")
    entries, changes = L.apply_suspicions(_entries(spark, {"a": "క", "b": "గ"}), rows)
    assert {(r.glyphs, r.unicode) for r in entries.collect()} == {("a", "ఖ"), ("b", "గ")} and [tuple(r) for r in changes.collect()] == [("a", "క", "ఖ")]


# --- recipes -----------------------------------------------------------------------------------------

NAMES, RECIPES = "glyph string, name string, unicode string", "recipe int, names array<string>, unicode string"


def test_compile(spark):
    names = spark.createDataFrame([("1", "u", "ు"), ("2", "u", "ు"), ("3", "ka", "క"), ("4", "mark", "∅"), ("5", "open", "")], NAMES)
    recipes = spark.createDataFrame([(1, ["ka", "u"], "కూ"), (2, ["open", "mark"], "మ")], RECIPES)
    got = {r.glyphs: r.unicode for r in R.compile_mapping(names, recipes).collect()}
    assert got == {"1": "ు", "2": "ు", "3": "క", "4": "", "31": "కూ", "32": "కూ", "54": "మ"}


@pytest.mark.parametrize("names, recipes, problem", [
    ([("1", "a", "క"), ("1", "b", "గ")], [], "listed twice"),
    ([("1", "a", "క"), ("2", "a", "గ")], [], "several texts"),
    ([("1", "a", "క")], [(1, ["a"], "x")], "one name"),
    ([("1", "a", "క")], [(1, ["a", "z"], "x")], "unknown names"),
    ([(str(i), "a", "క") for i in range(9)], [(1, ["a", "a"], "x")], "too many variants"),
    ([("1", "a", "క")], [(1, ["a", "a"], "x"), (2, ["a", "a"], "y")], "two texts"),
    ([("1", "a", "క"), ("2", "b", "గ")], [(1, ["a", "b"], "కగ")], "redundant"),
])
def test_violations(spark, names, recipes, problem):
    with pytest.raises(ValueError, match=problem):
        R.compile_mapping(spark.createDataFrame(names, NAMES), spark.createDataFrame(recipes, RECIPES))


# --- bitmaps and layout ------------------------------------------------------------------------------


def _flood(mask, corners):
    names, n = np.zeros(mask.shape, int), 0
    steps = [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1) if corners or not (y and x)]
    for start in zip(*np.nonzero(mask), strict=True):
        if names[start]:
            continue
        n += 1
        todo = [start]
        while todo:
            y, x = todo.pop()
            if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not names[y, x]:
                names[y, x] = n
                todo += [(y + a, x + b) for a, b in steps]
    return names, n


@pytest.mark.parametrize("corners", [True, False])
def test_label_equals_a_flood(corners):
    rng = np.random.default_rng(3)
    for _ in range(30):
        mask = rng.random((rng.integers(1, 15), rng.integers(1, 15))) < 0.45
        got, want = B.label(mask, corners), _flood(mask, corners)
        assert got[1] == want[1] and (got[0] == want[0]).all()


def test_measures_of_shapes():
    ring = np.zeros((30, 30), bool)
    ring[2:28, 2:28] = True
    ring[10:20, 10:20] = False
    assert B.holes(ring, 1) == 1 and B.holes(ring, 101) == 0 and B.in_hole(15, 15, ring) and not B.in_hole(0, 0, ring)
    grid, moved = B.to_grid(ring), np.roll(B.to_grid(ring), 1, 0)
    assert B.stray_share(grid, np.stack([grid, moved])).max() < 0.01 < B.stray_share(grid, ~grid[None])[0]
    canvas = B.to_canvas(ring, 30)
    filled = ring.copy()
    filled[10:20, 10:20] = True
    assert B.thick_blob(canvas, np.roll(canvas, 1, 1)) == 0 and B.thick_blob(canvas, B.to_canvas(filled, 30)) > B.THICK_BLOB
    assert B.unpacked(B.packed(ring), (30, 30)).tolist() == ring.tolist()


def test_layout_of_a_page(spark):
    boxes = [(0, 100, 20, 140), (25, 100, 45, 140), (28, 80, 40, 98), (200, 100, 220, 140), (0, 300, 20, 340), (26, 142, 40, 160)]
    parts = spark.createDataFrame([(1, i, *b, 40.0) for i, b in enumerate(boxes)], "page int, i int, x0 int, y0 int, x1 int, y1 int, body double")
    got = {r.i: (r.line, r.word, r.position, r.band) for r in SL.layout(parts, ["page"], "i").collect()}
    assert got == {0: (1, 1, 1, "main"), 1: (1, 1, 2, "main"), 2: (1, 1, 3, "above"), 5: (1, 1, 4, "below"), 3: (1, 2, 1, "main"), 4: (2, 1, 1, "main")}


def test_components_of_bitmaps(spark):
    ink = np.zeros((60, 60), bool)
    ink[5:35, 5:35] = True
    ink[15:25, 15:25] = False
    ink[19:21, 18:22] = True  # a dot in the hole becomes part of its host
    rows = spark.createDataFrame([(1, bytearray(B.packed(ink)), 60, 60), (2, None, 60, 60)], "page int, bitmap binary, height int, width int")
    got = SL.find_components(rows, ["page"], least=8).collect()
    assert [(r.page, r.x0, r.y0, r.x1, r.y1, r.ink) for r in got] == [(1, 5, 5, 35, 35, 900 - 100 + 8)]
    made = SI.features(SL.find_components(rows, ["page"], least=8).withColumn("body", F.lit(30.0)), ["page"]).first()
    assert (made.height, made.aspect, made.holes) == (1.0, 1.0, 1)


def test_neighbours_and_checks(spark):
    rng = np.random.default_rng(8)
    forms = [np.kron(rng.random((8, 8)) < 0.5, np.ones((6, 6), bool)) for _ in range(3)]
    rows = [(3 * k + j, bytearray(B.packed(np.roll(f, j, 0))), bytearray(B.packed(B.to_canvas(np.roll(f, j, 0), 48))), 1.0, 1.0, "main", 1) for k, f in enumerate(forms) for j in range(2)]
    rows += [(20, None, None, 1.0, 1.0, "main", 1), (21, rows[0][1], rows[0][2], 2.0, 1.0, "main", 1), (22, rows[0][1], rows[0][2], 1.0, 1.0, "above", 1)]
    shapes = spark.createDataFrame(rows, "shape_id bigint, grid binary, canvas binary, height double, aspect double, band string, holes int")
    near = SI.gated_neighbours(shapes, shapes)
    assert {(r.shape_id, r.other) for r in near.collect()} == {(0, 1), (1, 0), (3, 4), (4, 3), (6, 7), (7, 6)}
    assert {tuple(r) for r in SI.best_match(SI.thick_tested(near, shapes, shapes)).collect()} == {(0, 1), (1, 0), (3, 4), (4, 3), (6, 7), (7, 6)}
    led = {r.shape_id: r.leader for r in SI.lead_clusters(shapes, ["shape_id"], "shape_id").collect()}
    assert led == {0: 0, 1: 0, 3: 3, 4: 3, 6: 6, 7: 6, 21: 21, 22: 22}
    matches = spark.createDataFrame([(1, [1]), (2, [2, 5]), (3, [4])], "shape_id bigint, matches array<bigint>")
    checked = SI.checks(spark.createDataFrame([(1,), (2,), (2,), (3,), (9,)], "shape_id bigint"), matches)
    assert {r.verdict: r["count"] for r in SI.verdict_census(checked).collect()} == {"clean": 1, "ambiguous": 2, "drifted": 2}
    assert {tuple(r) for r in SI.rival_pairs(checked, spark.createDataFrame([(5, 2), (8, 7)], "shape_id bigint, other bigint")).collect()} == {(2, 5, 2), (3, 4, 1), (7, 8, 0)}


def test_kept_ids_are_those_of_the_catalog(spark, tmp_path):
    box = "bbox struct<x0 int, y0 int, x1 int, y1 int>"
    rows = [("b", 1, 1, w, 1, s, (w, 0, w + 1, 9), 5) for w, s in ((2, 3), (4, 5999), (6, 70), (8, None), (1, 3), (10, 1000))]
    spark.createDataFrame([*rows, rows[0]], f"book string, page int, line int, word int, position int, shape_id bigint, {box}, ink int").write.parquet(f"{tmp_path}/occurrences.parquet")
    spark.createDataFrame([(3,), (3,), (5999,), (1000,), (None,)], "shape_id bigint").write.parquet(f"{tmp_path}/shape_catalog.parquet")
    assert [tuple(r) for r in curate_queries.keep_assignments(spark, str(tmp_path)).collect()] == [("b", 6, 3)]


def test_page_ranking(spark):
    rows = [("b", 1, s) for s in (1, 2)] + [("b", 2, s) for s in (1, 2, 3)] + [("b", 3, s) for s in (3, 4)] + [("b", 3, None)]
    got = SI.rank_pages(spark.createDataFrame(rows, "book string, page int, shape_id bigint"), ["book"]).orderBy("rank").collect()
    assert [(r.page, r.new_shapes) for r in got] == [(2, 3), (3, 1), (1, 0)] and got[1].covered == 1.0


def test_percentile_and_assignment(spark):
    rows = spark.createDataFrame([("b", 0.5)] * 18 + [("b", 0.6), ("b", 2.0), ("b", None)], "k string, v double")
    assert P.percentile(rows, ["k"], "v", 0.9).first().percentile == 0.6
    rng = np.random.default_rng(4)
    tables = {"f": rng.random((4, 6)), "g": rng.random((6, 4)), "h": rng.random((1, 1))}
    cells = [(f, f"g{i}", f"t{j}", float(x)) for f, t in tables.items() for (i, j), x in np.ndenumerate(t)]
    got = P.assign_glyphs(spark.createDataFrame(cells, "font string, glyph string, target string, score double")).collect()
    for f, t in tables.items():
        small, wide = (t, False) if t.shape[0] <= t.shape[1] else (t.T, True)
        best = max(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))
        mine = [r for r in got if r.font == f]
        assert abs(sum(r.score for r in mine) - best) < 1e-9 and len({r.target for r in mine}) == len({r.glyph for r in mine}) == len(mine) == len(small)
        for r in mine:
            rest = [x for j, x in enumerate(t[int(r.glyph[1:])]) if f"t{j}" != r.target]
            lead = r.score - max(rest, default=0.0)
            assert abs(r.margin - lead) < 1e-9 and r.status == ("duplicate" if lead < 0 else "sure" if r.score >= 0.8 and lead >= 0.1 else "likely" if r.score >= 0.6 else "doubtful")


def test_likeness_of_bitmaps(spark):
    grid = lambda *bits: bytearray(bits)
    left = spark.createDataFrame([("f", "a", grid(0xF0, 0)), ("g", "b", grid(0, 0))], "font string, glyph string, grid binary")
    right = spark.createDataFrame([("f", "x", grid(0xF0, 0)), ("f", "y", grid(0xFF, 0)), ("g", "z", grid(0, 0))], "font string, target string, grid binary")
    assert {(r.font, r.glyph, r.target, r.score) for r in P.likeness(left, right).collect()} == {("f", "a", "x", 1.0), ("f", "a", "y", 0.5), ("g", "b", "z", 0.0)}


# --- sources, sinks, streams -------------------------------------------------------------------------


def test_tsv_keeps_quotes_and_empty_texts(spark, tmp_path):
    path = tmp_path / "m.tsv"
    path.write_text('glyphs\tunicode\tfirst_page\n"\tక\t3\tdropped\n\nq\t\nq\tగ\tx\n', encoding="utf-8")
    assert {(r.glyphs, r.unicode, r.first_page, r.first_word) for r in tsv.load_entries(spark, str(path)).collect()} == {('"', "క", 3, ""), ("q", "గ", None, "")}
    assert tsv.load_entries(spark, str(tmp_path / "none.tsv")).count() == 0
    tsv.save_entries(tsv.load_entries(spark, str(path)), str(tmp_path / "out.tsv"))
    assert tsv.load_entries(spark, str(tmp_path / "out.tsv")).count() == 2
    (tmp_path / "bad.tsv").write_text("a\tb\n", encoding="utf-8")
    with pytest.raises(ValueError):
        tsv.checked_mapping(spark, str(tmp_path / "bad.tsv"))


def test_type1_codes(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text("char\tbyte\tconfirmed\na\t41\t\nb\t41\t42\nc\t\t\n", encoding="utf-8")
    assert {tuple(r) for r in tsv.load_type1_codes(spark, str(path)).collect()} == {("a", 0x41), ("b", 0x42)}


def test_raw_pages_to_glyphs(spark):
    char = lambda c, x: (c, (x, 90.0, x + 5.0, 99.0), [x, 100.0])
    block = [([((0.0, 0.0, 9.0, 9.0), [("X+Leg", 10.0, [0.0, 100.0], [char("", 0.0), char("b", 5.0)]), ("T3", 10.0, [0.0, 100.0], [char("z", 9.0)])])],), (None,)]
    rows = spark.createDataFrame([(1, [(3, "Type3", "T3"), (4, "TrueType", "X+Leg")], block)], pages.SCHEMA)
    fonts = pages.page_fonts(rows)
    got = pages.decoded(pages.without_type3(pages.raw_characters(rows), fonts), fonts, {"fonts": ["Leg"], "ascent": 0.8, "descent": 0.2}).orderBy("char_no").collect()
    assert [(r.char, r.is_legacy, r.box.y0, r.box.y1) for r in got] == [("A", True, 92.0, 102.0), ("b", True, 92.0, 102.0)]
    assert [r.family for r in pages.font_usage(fonts).collect()] == ["Leg", "T3"]


def test_files(spark, tmp_path):
    book = tmp_path / "book"
    (book / "input").mkdir(parents=True)
    assert pages.books(spark, str(tmp_path)) == ["book"]
    with pytest.raises(ValueError):
        pages.input_file(spark, str(book))
    (book / "input" / "a.pdf").write_bytes(b"x")
    assert pages.input_file(spark, str(book)).endswith("/a.pdf") and outputs.source_changed(spark, str(book / "input" / "a.pdf"), "0")
    pages.save_profile({"fonts": ["A"], "layout": None}, str(tmp_path / "p.json"))
    assert pages.load_profile(str(tmp_path / "p.json"), {"ascent": 1}) == {"ascent": 1, "fonts": ["A"]}
    batch = tmp_path / "batch"
    batch.mkdir()
    (batch / "page-7.txt").write_text("x", encoding="utf-8")
    assert outputs.approve(spark, str(batch), str(tmp_path / "ok"), str(tmp_path / "old")) == ["page-007.unicode.txt"]
    assert [(r.page, r.text) for r in pages.verified_pages(spark, str(tmp_path / "ok")).collect()] == [(7, "x")]
    assert outputs.archive(spark, str(tmp_path / "p.json"), str(tmp_path / "old"), "S").endswith("/old/p-S.json") and outputs.clean(spark, str(tmp_path / "old")) >= 2


def test_streams_equal_batches(spark, tmp_path):
    rows = [("b", 1, 1, w % 3, 1, 7, "2024-01-01 00:00:00") for w in range(6)] + [("b", 1, 2, 1, 1, None, "2024-01-02 00:00:00")]
    frame = spark.createDataFrame(rows, "book string, page int, line int, word int, position int, shape_id bigint, at string").withColumn("indexed_at", F.to_timestamp("at")).drop("at")
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    counts = ingest.first_deliveries(stream).where("shape_id is not null").groupBy("book", "shape_id").agg(F.count("*").alias("n"))
    seen = []
    ingest.resumable(counts, lambda f, _: seen.append({tuple(r) for r in f.collect()}), str(tmp_path / "state")).outputMode("complete").start().awaitTermination()
    assert seen[-1] == {("b", 7, 3)}
    words = spark.createDataFrame([("=x",)], "g string")
    words.write.parquet(str(tmp_path / "words"))
    mapping = Mapping(spark.createDataFrame([("=", "వ")], "glyphs string, unicode string"))
    done = ingest.converted(spark.readStream.schema("g string").parquet(str(tmp_path / "words")), "g", mapping)
    out = []
    ingest.resumable(done, lambda f, _: out.extend(r.text for r in f.collect()), str(tmp_path / "state2")).start().awaitTermination()
    assert out == ["వ⟦x⟧"]


def test_a_line_like_the_header_further_down_is_data(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text("﻿a\tb\n\n1\tx\r\na\tb\n2\n", encoding="utf-8")
    got = [(r.a, r.b, r.ordinal) for r in tsv.read_tsv(spark, str(path), "a string, b string").orderBy("ordinal").collect()]
    assert got == [("1", "x", 0), ("a", "b", 1), ("2", "", 2)]


def test_suspicions_progress_and_unmapped(spark, tmp_path):
    path = tmp_path / "s.tsv"
    path.write_text("glyphs\tsuggested\tstatus\treason\tpage\tword\na\tఖ\taccepted\tr\t7\tw\na\tగ\taccepted\tr\t8\tv\nn\tమ\taccepted\t\t\t\nb\t\taccepted\t\tx\t\nc\tట\trejected\t\t1\t\n", encoding="utf-8")
    entries, changes = L.apply_suspicions(_entries(spark, {"a": "క", "b": "ఘ", "c": "డ"}), tsv.load_suspicions(spark, str(path)))
    assert {(r.glyphs, r.unicode, r.first_page, r.first_word) for r in entries.collect()} == {("a", "గ", 8, "v"), ("n", "మ", None, ""), ("b", "ఘ", None, ""), ("c", "డ", None, "")}
    assert {tuple(r) for r in changes.collect()} == {("a", "క", "గ"), ("n", "", "మ")}
    done = tmp_path / "p.tsv"
    done.write_text("page\tglyphs\n3\t10\n3\t12\nx\t1\n5\t2\n", encoding="utf-8")
    assert sorted(r.page for r in tsv.load_progress(spark, str(done)).collect()) == [3, 5]
    tsv.save_unmapped(spark.createDataFrame([("x", 1), ("y", 5)], "glyphs string, count bigint"), str(tmp_path / "u.tsv"))
    assert [r.value for r in spark.read.text(str(tmp_path / "u.tsv")).collect()] == ["unmapped\tcount", "y\t5", "x\t1"]


def test_like_shapes_need_half_of_the_crops(spark):
    rng = np.random.default_rng(8)
    form = np.kron(rng.random((8, 8)) < 0.5, np.ones((6, 6), bool))
    other = form.copy()
    other[20:30, 20:30] ^= True
    row = lambda i, f: (i, bytearray(B.packed(f)), bytearray(B.packed(B.to_canvas(f, 48))), 1.0, 1.0, "main", 1)
    shapes = spark.createDataFrame([row(1, form), row(2, np.roll(form, 1, 0)), row(3, other)], "shape_id bigint, grid binary, canvas binary, height double, aspect double, band string, holes int")
    crops = spark.createDataFrame([(1, row(1, form)[2]), (1, row(3, other)[2]), (2, row(3, other)[2])], "shape_id bigint, canvas binary")
    assert {(r.shape_id, tuple(r.same)) for r in SI.same_shapes(shapes, crops).collect()} == {(1, (2, 3)), (2, (3,))}
    assert {(r.shape_id, tuple(r.same)) for r in SI.same_shapes(shapes, crops, spark.createDataFrame([(3,)], "shape_id bigint")).collect()} == {(1, (2,))}


def test_ocr_cache_numbers_words_by_page(spark, tmp_path):
    for page in (3, 12):
        (tmp_path / f"page-{page:03d}.json").write_text('[{"text": "a", "confidence": 9.5, "bbox": [1, 2, 3, 4]}, {"text": "b"}]', encoding="utf-8")
    got = {(r.page, r.ocr_no, r.text, r.confidence, r.bbox.y1) for r in pages.read_ocr_cache(spark, str(tmp_path)).collect()}
    assert got == {(p, n, t, c, y) for p in (3, 12) for n, t, c, y in ((1, "a", 9.5, 4.0), (2, "b", None, None))}


def test_output_changes_by_page(spark):
    from lipimala.operators.quality import page_changes

    rows = spark.createDataFrame([(1, "అ ఆ ఇ", "అ ఆ ఈ"), (2, "a", "a"), (3, None, "x")], "page int, old string, new string")
    got = {r.page: (r.before_words, round(r.word_error_rate, 4), round(r.character_error_rate, 4)) for r in page_changes(rows, "old", "new").collect()}
    assert got[1] == (3, 0.3333, 0.3333) and got[2] == (1, 0.0, 0.0) and got[3][0] == 0


def _many_shapes(spark, n=260):
    """Noisy prints of two forms, some copies of others, in two groups of like measures."""
    rng = np.random.default_rng(4)
    forms = [np.zeros((B.GRID, B.GRID), bool), np.zeros((B.GRID, B.GRID), bool)]
    forms[0][8:40, 10:16] = forms[1][20:26, 4:44] = True
    rows = []
    for i in range(n):
        if i % 5 == 4:
            rows.append((1000 - i, *rows[i // 2][1:]))
            continue
        grid = forms[i % 2] ^ (rng.random((B.GRID, B.GRID)) < 0.02 * rng.random())
        canvas = np.zeros(B.CANVAS, bool)
        canvas[30:78, 100:148] = forms[i % 2]
        at = rng.integers(0, 9)
        canvas[60 : 60 + at, 110 : 110 + at] ^= True
        rows.append((1000 - i, B.packed(grid), B.packed(canvas) if i % 11 else None, float(np.exp(0.3 * rng.random())), 0.9 + 0.1 * rng.random(), "main", int(i % 3 == 0)))
    return rows, spark.createDataFrame(rows, "shape_id bigint, grid binary, canvas binary, height double, aspect double, band string, holes int")


def test_neighbours_of_many_like_shapes_equal_all_pairs_and_are_found_without_a_join(spark):
    rows, shapes = _many_shapes(spark)
    got = {(r.shape_id, r.rank): (r.other, r.stray) for r in SI.gated_neighbours(shapes, shapes, k=5, distance=0.35).collect()}
    grids, want = {r[0]: B.unpacked(r[1], (B.GRID, B.GRID)) for r in rows}, {}
    for a in rows:
        like = [b for b in rows if b[0] != a[0] and b[6] == a[6] and abs(np.log(a[3] / b[3])) <= 0.1 and abs(np.log(a[4] / b[4])) <= 0.1]
        near = sorted((float(B.stray_share(grids[a[0]], grids[b[0]][None])[0]), b[0]) for b in like)
        want |= {(a[0], k): (other, d) for k, (d, other) in enumerate([x for x in near if x[0] <= 0.35][:5], 1)}
    assert got == want and len(got) > 1000
    same = SI.same_shapes(shapes, shapes)
    canvases = spark.createDataFrame([(r[0], r[2]) for r in rows if r[2]], "shape_id bigint, canvas binary")
    assert {r.shape_id: r.same for r in same.collect()} == {r.shape_id: r.same for r in SI.same_shapes(shapes, canvases).collect()}
    for frame in (SI.gated_neighbours(shapes, shapes), same):
        assert "Join" not in frame._jdf.queryExecution().executedPlan().toString()


def test_blobs_of_many_pairs_equal_those_of_one():
    rng = np.random.default_rng(6)
    canvases = np.zeros((60, *B.CANVAS), bool)
    canvases[:, 40:90, 90:150] = rng.random((60, 50, 60)) < 0.5
    canvases[:, 50:70, 100:130] = True
    for i in range(60):
        canvases[i, 50 : 50 + i % 9, 100 : 100 + i % 7] = False
    canvases[7, 0], canvases[8, :, -1], canvases[9] = True, True, False
    data = np.packbits(canvases.reshape(60, -1), axis=1)
    i, j = rng.integers(0, 60, (2, 300))
    for limit in (B.THICK_BLOB, 60):
        assert B.thick_blobs(data[i], data[j], limit).tolist() == [min(limit + 1, B.thick_blob(canvases[a], canvases[b])) for a, b in zip(i, j, strict=True)]


def _counted(spark):
    """Shapes checked occurrence by occurrence, and once with their occurrences counted."""
    matches = spark.createDataFrame([(1, [1]), (2, [2, 5]), (3, [4])], "shape_id bigint, matches array<bigint>")
    rows = spark.createDataFrame([(1,), (2,), (2,), (3,), (9,)], "shape_id bigint")
    return SI.checks(rows, matches), SI.checks(rows.groupBy("shape_id").agg(F.count("*").alias("n")), matches)


def test_census_of_counted_shapes_is_that_of_their_occurrences(spark):
    each, counted = _counted(spark)
    assert {tuple(r) for r in SI.verdict_census(counted, "n").collect()} == {tuple(r) for r in SI.verdict_census(each).collect()} == {("clean", 1), ("ambiguous", 2), ("drifted", 2)}


def test_rival_pairs_of_counted_shapes_are_those_of_their_occurrences(spark):
    each, counted = _counted(spark)
    near = spark.createDataFrame([(5, 2), (2, 5), (8, 7), (7, 8)], "shape_id bigint, other bigint")
    assert sorted(SI.rival_pairs(counted, near, "n").collect()) == sorted(SI.rival_pairs(each, near).collect()) == [(2, 5, 2), (3, 4, 1), (7, 8, 0)]


def test_flagged_counted_shapes_are_those_of_their_occurrences(spark):
    each, counted = _counted(spark)
    assert sorted(SI.flagged(counted, "n").collect()) == sorted(SI.flagged(each).collect()) == [(2, 2), (3, 1), (9, 1)]


def test_alike_canvases_equal_those_of_one_and_clear_differences_need_no_shifts(monkeypatch):
    rng = np.random.default_rng(9)
    canvases = np.zeros((90, *B.CANVAS), bool)
    for k, at in enumerate(rng.integers(0, 40, (90, 2))):
        canvases[k, 40:100, 90:150] = np.kron(rng.random((10, 10)) < 0.5, np.ones((6, 6), bool)) if k % 3 else canvases[k // 2, 40:100, 90:150]
        canvases[k, 45 + at[0] : 45 + at[0] + k % 9, 100 + at[1] : 100 + at[1] + k % 8] ^= True
        canvases[k] = np.roll(canvases[k], k % 2, 1)
    canvases[7, 0], canvases[8, :, -1], canvases[9], canvases[10] = True, True, False, canvases[9]
    canvases[11] = canvases[12] ^ (np.arange(256) == 120) & (np.arange(128)[:, None] % 40 > 3)
    canvases[13] = canvases[14]
    canvases[13, 60, 90:150:2] ^= True
    canvases[20, 50:90, 60:63] = True  # a long blob no wider than a pixel when one is taken off all round
    data = np.packbits(canvases.reshape(90, -1), axis=1)
    i, j = (x.ravel() for x in np.mgrid[:90, :90])
    for limit in (B.THICK_BLOB, 4, 60):
        want = [B.thick_blob(canvases[a], canvases[b]) <= limit for a, b in zip(i[::7], j[::7], strict=True)]
        assert B.thick_alike(data, data, i[::7], j[::7], limit).tolist() == want and 100 < sum(want) < 1000
    one, other = np.zeros((2, *B.CANVAS), bool)
    one[40:80, 90:110], other[40:80, 150:170] = True, True
    tried = []
    monkeypatch.setattr(B, "_thick", lambda a, b, *shift, thick=B._thick: tried.append((len(a), *shift)) or thick(a, b, *shift))
    pair = np.packbits(np.stack([one, other]).reshape(2, -1), axis=1)
    assert not B.thick_alike(pair, pair, np.zeros(50, int), np.ones(50, int)).any() and not any(n for n, *shift in tried if shift)
    assert B.thick_alike(pair[:0], pair, np.zeros(0, int), np.zeros(0, int)).tolist() == []


def test_forms_to_which_many_are_left_are_compared_at_once_with_the_same_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(3)
    grids = rng.random((400, B.GRID, B.GRID)) < 0.35  # all about as far from each other
    height, aspect = np.exp(0.1 * rng.integers(-2, 3, 400)), -np.exp(0.15 * rng.random(400))
    shapes = spark.createDataFrame([(i, B.packed(g), float(height[i]), float(aspect[i] * (-1) ** (i % 9)), "main", 1) for i, g in enumerate(grids)], "shape_id bigint, grid binary, height double, aspect double, band string, holes int")
    got = {(r.shape_id, r.rank): (r.other, r.stray) for r in SI.gated_neighbours(shapes, shapes, k=5, distance=0.9).collect()}
    want = {}
    sign = np.array([(-1) ** (i % 9) for i in range(400)])
    with np.errstate(invalid="ignore"):
        for i in range(400):
            like = np.flatnonzero((np.abs(np.log(height[i] / height)) <= 0.1) & (np.abs(np.log(aspect[i] * sign[i] / (aspect * sign))) <= 0.1))
            like = like[like != i]
            near = sorted(zip(B.stray_share(grids[i], grids[like]).tolist(), like.tolist(), strict=True))[:5]
            want |= {(i, k): (other, d) for k, (d, other) in enumerate(near, 1)}
    assert got == want and len(got) == 2000
    picked = []
    monkeypatch.setattr(SI, "_strays", lambda left, i, right, j, strays=SI._strays: picked.append(len(i)) or strays(left, i, right, j))
    table = pa.table({"shape_id": np.arange(400), "band": ["main"] * 400, "holes": pa.array([1] * 400, pa.int32()), "height": np.ones(400), "aspect": np.ones(400), "bits": [B.packed(g) for g in grids]})
    SI._nearest(5, 0.9, None)(table, table)
    assert sum(picked) < 400 * 400 / 8


def test_rival_pairs_of_many_shapes_need_no_sizes_of_blobs(spark, tmp_path):
    rows, shapes = _many_shapes(spark, 120)
    shapes.write.parquet(f"{tmp_path}/shape_catalog.parquet")
    used = [("b", 1, 1, w, 1, rows[w // 2][0], (w, 0, w + 1, 9), 5) for w in range(200)]
    spark.createDataFrame(used, "book string, page int, line int, word int, position int, shape_id bigint, bbox struct<x0 int, y0 int, x1 int, y1 int>, ink int").write.parquet(f"{tmp_path}/occurrences.parquet")
    assert dict(curate_queries._near(spark, str(tmp_path)).dtypes)["alike"] == "boolean"
    grids, canvases = ({r[0]: r[n] and B.unpacked(r[n], size) for r in rows} for n, size in ((1, (B.GRID, B.GRID)), (2, B.CANVAS)))
    counts, want = {r[0]: 2 * (n < 100) for n, r in enumerate(rows)}, {}
    for a in rows:
        like = [b for b in rows if b[0] != a[0] and b[6] == a[6] and abs(np.log(a[3] / b[3])) <= 0.1 and abs(np.log(a[4] / b[4])) <= 0.1]
        near = sorted((float(B.stray_share(grids[a[0]], grids[b[0]][None])[0]), b[0]) for b in like)
        for other in [o for d, o in near if d <= SI.WIDE_STRAY][: SI.WIDE]:
            pair, both = (min(a[0], other), max(a[0], other)), canvases[a[0]] is not None and canvases[other] is not None
            passes = both and B.thick_blob(canvases[a[0]], canvases[other]) <= B.THICK_BLOB
            want[pair] = want.get(pair, 0) + counts[a[0]] * passes
    assert {(r["first"], r["second"]): r["count"] for r in curate_queries.rival_pairs(spark, str(tmp_path)).collect()} == want and len(set(want.values())) > 2


def test_rival_pairs_read_neighbours_once_and_send_a_shape_once_to_a_tile(spark, tmp_path):
    rows, shapes = _many_shapes(spark, 150)
    shapes.unionByName(shapes.where("shape_id % 7 = 0")).write.parquet(f"{tmp_path}/shape_catalog.parquet")
    used = [("b", 1, 1, w, 1, rows[w % 90][0] if w % 4 else 100_000 + w, (w, 0, w + 1, 9), 5) for w in range(250)]
    spark.createDataFrame([*used, *used[:40]], "book string, page int, line int, word int, position int, shape_id bigint, bbox struct<x0 int, y0 int, x1 int, y1 int>, ink int").write.parquet(f"{tmp_path}/occurrences.parquet")
    found = curate_queries.rival_pairs(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and len(re.findall(r"\bMapInArrow", plan)) == 1
    shapes = spark.read.parquet(f"{tmp_path}/shape_catalog.parquet").dropDuplicates(["shape_id"])
    near = SI.gated_neighbours(shapes.select("*"), shapes, k=SI.WIDE, distance=SI.WIDE_STRAY, limit=B.THICK_BLOB).cache()
    assert sorted(near.collect()) == sorted(curate_queries._near(spark, str(tmp_path)).collect())
    want = SI.rival_pairs(curate_queries._checked(spark, str(tmp_path), near), near, "n").collect()
    assert sorted(found.collect()) == sorted(want) and len(want) > 100 and {r["count"] > 0 for r in want} == {True, False}
    near.unpersist()


def test_alike_canvases_of_one_side_equal_those_of_two():
    rng = np.random.default_rng(12)
    canvases = np.zeros((40, *B.CANVAS), bool)
    canvases[:, 40:100, 90:150] = np.kron(rng.random((10, 10)) < 0.5, np.ones((6, 6), bool))
    for k, at in enumerate(rng.integers(0, 40, (40, 2))):
        canvases[k, 45 + at[0] : 49 + at[0] + k % 9, 100 + at[1] : 104 + at[1] + k % 8] ^= True
        canvases[k] = np.roll(canvases[k], k % 3, k % 2)
    canvases[7, 0], canvases[8, :, -1], canvases[9] = True, True, False  # ink at an edge, where the sides may differ; none
    data = np.packbits(canvases.reshape(40, -1), axis=1)
    i, j = (x.ravel() for x in np.mgrid[:40, :40])
    both = B.thick_alike(data, data, i, j)
    assert both.tolist() == B.thick_alike(data, data.copy(), i, j).tolist() == [B.thick_blob(canvases[a], canvases[b]) <= B.THICK_BLOB for a, b in zip(i, j, strict=True)]
    assert 0.05 < both.mean() < 0.95
