"""Script rules, glyph functions, segmentation and transcoding."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lipimala.functions import glyphs as G
from lipimala.functions import telugu as T
from lipimala.operators import segment as S
from lipimala.operators import transcode as TR
from lipimala.operators.compare import shape_names
from lipimala.operators.learn import segmented

V, Z = T.VIRAMA, T.ZWNJ


def one(spark, column, **values):
    ddl = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], ddl).select(column.alias("x")).first().x


@pytest.mark.parametrize("text, want", [
    ("త ో", "తో"),  # a blank before a sign
    ("◌ెక", "కె"),  # a sign drawn before its letter
    (f"◌{V}రక", f"క{V}ర"),  # a subscript drawn before its cluster
    (f"కి{V}ష", f"క{V}షి"),  # a sign drawn before the subscript
    (f"క{V}{Z}{V}ష", f"క{V}ష{V}{Z}"),
    (f"క{V}ర{V}త", f"క{V}త{V}ర"),
    (f"క{V}య{V}ర", f"క{V}ర{V}య"),
    (f"క{V}ర{V}య{V}ల{V}ర", f"క{V}ల{V}ర{V}ర{V}య"),
    ("కై", "కై"),
    ("", ""),
    (None, None),
])
def test_normalise(spark, text, want):
    assert one(spark, T.normalise(F.col("t")), t=text) == want
    if text is not None:
        assert T.normalise_word(text) == want


@pytest.mark.parametrize("text, want", [(f"క{V}", f"క{V}{Z}"), (f"క{V}ష", f"క{V}ష"), (f"క{V}{Z}", f"క{V}{Z}"), (f"క{V} ష", f"క{V}{Z} ష"), (f"◌{V}ష", f"{V}ష")])
def test_finish(spark, text, want):
    assert one(spark, T.finish(F.col("t")), t=text) == want
    assert T.finish_word(text) == want


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=f"కరయషిెై{V}{Z}◌ఖ", max_size=14), min_size=1, max_size=20))
def test_column_and_word_forms_agree(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.finish(F.col("t")).alias("f"), T.comparable(F.col("t")).alias("c"), T.drawing_orders(F.col("t")).alias("o")).collect()
    for r in rows:
        assert r.f == T.finish_word(r.t) and r.c == T.comparable_word(r.t) and set(r.o) == T.drawing_orders_word(r.t)


def test_small_functions(spark):
    assert one(spark, T.comparable(F.col("t")), t=f"“క{Z}”") == "‘‘క’’"
    assert one(spark, T.is_telugu_word(F.col("t")), t="తోతొ!") and not one(spark, T.is_telugu_word(F.col("t")), t="తోతొ\n")
    assert one(spark, T.slug(F.col("t")), t="Maha - Bharatam: 3!") == "maha-bharatam-3"
    assert one(spark, T.syllables(F.col("t")), t=f"క{V}షిఅx") == [f"క{V}షి", "అ", "x"]
    assert one(spark, T.code_points(F.col("t")), t="క😀") == "U+0C15 U+1F600"
    assert one(spark, G.font_family(F.col("t")), t="ABC+Anu,Bold") == "Anu"
    assert one(spark, G.symbol_decode(F.col("t")), t="x") == "Ax"
    assert one(spark, G.symbol_encode(F.col("t"), "AB"), t="AB") == "" and one(spark, G.symbol_encode(F.col("t"), "AB"), t="C") is None
    assert one(spark, G.readable(F.concat(F.lit("a"), G.shape_token(F.lit(77)))), t="") == "a#77"
    with pytest.raises(Exception, match="outside the private use plane"):
        one(spark, G.shape_token(F.lit(70_000)), t="")


def test_shapes_of_any_id_have_tokens(spark):
    ids = [0, 65_533, 65_534, 70_000, 65_534**2 - 1, 65_534**2, 2**63 - 1, -1, -70_000, -(2**63)]
    rows = spark.createDataFrame([(i,) for i in ids], "id bigint").withColumn("t", G.shape_tokens(F.col("id")))
    shown = G.readable(F.concat(F.lit("x"), "t", "t", F.lit("\U00100005y")))
    for r in rows.select("id", G.shape_of_token(F.col("t")).alias("back"), shown.alias("shown"), F.length("t").alias("n")).collect():
        assert r.back == r.id and r.shown == f"x#{r.id}#{r.id}\U00100005y" and (r.n == 1) == (0 <= r.id <= 65_533)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance(spark):
    rng = random.Random(2)
    pairs = [(list("kitten"), list("sitting")), ([], ["a", "b"]), (["a"], []), ([], [])] + [([rng.choice("abc") for _ in range(rng.randrange(8))], [rng.choice("abc") for _ in range(rng.randrange(8))]) for _ in range(60)]
    rows = spark.createDataFrame(pairs, "a array<string>, b array<string>").select("a", "b", G.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r.d == _distance(r.a, r.b) for r in rows)


# --- segmentation ------------------------------------------------------------------------------------


def test_rows_are_anchored_to_their_first_member(spark):
    rows = spark.createDataFrame([(1, i, b) for i, b in enumerate([0.0, 1.5, 3.0, 4.5])] + [(2, 0, 9.0)], "page int, no int, b double")
    got = {(r.page, r.no): r.row for r in S.baseline_rows(rows, ["page"], "b", ["no"]).collect()}
    assert got == {(1, 0): 1, (1, 1): 1, (1, 2): 2, (1, 3): 2, (2, 0): 1}


def _line(spark, chars):
    rows = [(1, i, c, legacy, w, (float(i), 0.0, i + 1.0, 1.0)) for i, (c, legacy, w) in enumerate(chars)]
    return spark.createDataFrame(rows, "line int, pos int, char string, is_legacy boolean, width double, box struct<x0 double,y0 double,x1 double,y1 double>")


def test_words_units_runs(spark):
    glyphs = _line(spark, [("=", True, 6.8), ("∞", True, 3.1), ("H", True, 5.7), ("õ", True, 0.0), (" ", True, 1.0), ("a", False, 2.0), ("#", True, 0.0), ("x", None, 1.0)])
    words = {r.word: (r.text, list(r.units), r.box.x0, r.box.x1) for r in S.words_of(glyphs, ["line"]).collect()}
    assert words == {1: ("=∞Hõ", ["=", "∞", "Hõ"], 0.0, 4.0), 2: ("#", ["#"], 6.0, 7.0)}
    assert [r.run for r in S.script_runs(glyphs, ["line"]).orderBy("pos").collect()][:7] == [1, 1, 1, 1, 1, 2, 3]


# --- transcoding -------------------------------------------------------------------------------------

TABLE = {"=": "వ", "=∞": "మ", "=Ú": "ము", "#": "న", "q": "", " ": "never"}


def _mapping(spark, table=None):
    return TR.Mapping(spark.createDataFrame(list((table or TABLE).items()) + [("", "x"), (None, "y")], "glyphs string, unicode string"))


def _naive(text, table):
    table, out, at = {**table, " ": " "}, [], 0
    while at < len(text):
        key = next((text[at : at + n] for n in range(min(len(text) - at, max(map(len, table))), 0, -1) if text[at : at + n] in table), None)
        if key:
            out.append((key, table[key]))
        elif out and out[-1][1] is None:
            out[-1] = (out[-1][0] + text[at], None)
        else:
            out.append((text[at], None))
        at += len(key or " ")
    return out


def test_longest_match_equals_a_naive_walk(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("=∞Ú#q xy\n(*") for _ in range(rng.randrange(25))) for _ in range(300)] + ["", "x" * 20_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    source = spark.createDataFrame(list(TABLE.items()), "glyphs string, unicode string")
    compiled = TR.with_segments(rows, "t", _mapping(spark)).select("i", "segments")
    joined = TR.segments_by_join(rows.where("length(t) < 100"), "i", "t", source)
    for got in (compiled, joined):
        for r in got.collect():
            assert [(s.glyphs, s.unicode) for s in r.segments] == _naive(texts[r.i], TABLE)


def test_the_joined_form_broadcasts_nothing_and_walks_a_text_once(spark):
    rows = spark.createDataFrame([(i // 2, "=∞Ú"[: i % 4]) for i in range(40)] + [(None, "=∞"), (7, None)], "i int, t string")
    source = spark.createDataFrame(list(TABLE.items()), "glyphs string, unicode string")
    joined = TR.segments_by_join(rows, "i", "t", source)
    got = sorted(((r.i, r.segments and [tuple(s) for s in r.segments]) for r in joined.collect()), key=str)
    assert got == sorted(((r.i, r.t and _naive(r.t, TABLE) if r.t != "" else []) for r in rows.collect()), key=str)
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


def test_the_joined_form_finds_long_keys_and_keeps_nulls(spark):
    rows = spark.createDataFrame([(1, "a" * 60 + "b"), (2, None), (None, "ab"), (3, ""), (4, "xab")], "i int, t string")
    source = spark.createDataFrame([("a" * 60, "long"), ("ab", "short"), (None, "n")], "glyphs string, unicode string")
    forms = [segmented(rows, "t", source, limit=limit) for limit in (100, 0)]
    got = [{(r.i, r.t): r.segments and [tuple(s) for s in r.segments] for r in form.select("i", "t", "segments").collect()} for form in forms]
    assert got[0] == got[1] and got[0][1, "a" * 60 + "b"] == [("a" * 60, "long"), ("b", None)] and got[0][2, None] is None and len(got[0]) == 5


def test_shape_names_with_few_and_with_many_names(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, "ba?"), (3, ""), (4, None), (5, "q")], "i int, g string")
    names = spark.createDataFrame([("a", "ka"), ("b", "u_hook")], "glyph string, name string")
    want = {1: "ka u_hook", 2: "u_hook ka ?", 3: "", 4: None, 5: "?"}
    for limit in (2, 1):
        assert {r.i: r.shapes for r in shape_names(rows, "g", names, limit=limit).collect()} == want
    assert {r.shapes for r in shape_names(rows.where("i < 3"), "g", names.limit(0)).collect()} == {""}


def test_render_and_coverage(spark):
    rows = TR.with_segments(spark.createDataFrame([("a", "=∞ xy#"), ("a", "q"), ("b", None), ("b", "")], "k string, t string"), "t", _mapping(spark))
    assert [r.x for r in rows.where("t <> ''").select(TR.render(F.col("segments")).alias("x")).collect()] == ["మ ⟦xy⟧న", ""]
    assert {r.k: (r.glyphs, r.unmapped, r.ratio) for r in TR.coverage(rows, "segments", ["k"]).collect()} == {"a": (6, 2, 1 - 2 / 6), "b": (0, 0, 1.0)}
    assert [tuple(r) for r in TR.unmapped_report(rows, "segments").collect()] == [("xy", 1)]


def test_too_large_a_mapping_is_refused(spark):
    with pytest.raises(ValueError, match="segments_by_join"):
        TR.Mapping(spark.range(30).select(F.col("id").cast("string").alias("glyphs"), F.lit("x").alias("unicode")), limit=20)


def test_scanned_words(spark):
    words = spark.createDataFrame([(1, [7, 8, 9, 7]), (2, [7])], "w int, shape_ids array<bigint>")
    done = TR.scan_transcode(words, spark.createDataFrame([(7, "క")], "shape_id bigint, unicode string"), ["w"])
    assert {r.w: (r.text, list(r.unmapped), r.glyphs) for r in done.collect()} == {1: ("క⟦#8#9⟧క", [8, 9], 4), 2: ("క", [], 1)}
    assert {tuple(r) for r in TR.unmapped_ids(done).collect()} == {(8, 1), (9, 1)}


def test_byte_codec(spark):
    codec = G.ByteCodec("mac_roman", {0xC6: "Δ", 0xD0: "-", 0xDB: "¤"})
    assert [codec.chars[b] for b in (0x3D, 0xB0, 0xC6, 0xD0, 0xDB)] == ["=", "∞", "Δ", "-", "¤"]
    rows = spark.createDataFrame([(c,) for c in ("=", "∆", "Δ", "-", "–", "€", "é", "క")], "c string")
    got = {r.c: (r.b, r.k) for r in rows.select("c", codec.byte_of(F.col("c")).alias("b"), codec.canonical(F.col("c")).alias("k")).collect()}
    assert got == {"=": (0x3D, "="), "∆": (0xC6, "Δ"), "Δ": (0xC6, "Δ"), "-": (0xD0, "-"), "–": (0xD0, "-"), "€": (0xDB, "¤"), "é": (0x8E, "é"), "క": (None, "క")}
    assert len(codec.table()) == 224 and G.ByteCodec("cp1252").chars[0x81] == ""


def test_pieces_of_a_row_are_joined_from_left_to_right(spark):
    pieces = [(1, "29", 300.0, 100.0), (2, "=∞", 80.0, 100.5), (3, "x", 80.0, 120.0), (4, "y", 10.0, 103.0)]
    rows = [("p", k, i, c, True, left, base, left + 5 * i) for k, text, left, base in pieces for i, c in enumerate(text)]
    glyphs = spark.createDataFrame(rows, "page string, piece int, glyph_no int, char string, is_legacy boolean, left double, baseline double, box double")
    got = S.joined_rows(glyphs, ["page"], ["piece"]).orderBy("row", "pos").collect()
    assert [("".join(r.char for r in got if r.row == k), [r.pos for r in got if r.row == k]) for k in (1, 2, 3)] == [("=∞ 29", [1, 2, 3, 4, 5]), ("y", [1]), ("x", [1])]
    blank = next(r for r in got if r.char == " ")
    assert not blank.is_legacy and blank.box == 300.0
    assert S.joined_rows(glyphs.limit(0), ["page"], ["piece"]).count() == 0
