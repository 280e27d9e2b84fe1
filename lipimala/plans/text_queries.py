"""Queries of script rules, glyph functions, segmentation and transcoding, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lipimala.functions import glyphs as G
from lipimala.functions import telugu as T
from lipimala.operators import segment as S
from lipimala.operators import transcode as TR
from lipimala.runtime import table

METHODS = ("ocr-learning", "shape-naming", "type1-layout")

# --- shared inputs -----------------------------------------------------------------------------------


def mapping_of(spark, sf_dir, method):
    """The mapping of one method, as a user selects it."""
    return TR.Mapping(table(spark, sf_dir, "mapping_entries").where(F.col("method") == method))


def events(spark, sf_dir):
    return table(spark, sf_dir, "learn_events").dropDuplicates(["event_id"])


def occurrences(spark, sf_dir):
    key = ["book", "page", "line", "word", "position"]
    return table(spark, sf_dir, "occurrences").drop("indexed_at").repartition("book", "page").dropDuplicates(key)


# SQL: the mapping of a method as (k, u), its pattern, and a text's tokens.
MAP_SQL = """m AS (SELECT glyphs AS k, max(coalesce(unicode, '')) AS u FROM mapping_entries WHERE method = '{method}' AND glyphs <> '' AND glyphs <> ' '
  GROUP BY 1 UNION ALL SELECT ' ', ' '),
pat AS (SELECT '(?s)' || string_agg(regexp_escape(k), '|' ORDER BY length(k) DESC, k) || '|.' AS p FROM m)"""
EVENTS_SQL = "ev AS (SELECT event_id, any_value(book) AS book, any_value(page_number) AS page, any_value(glyphs) AS glyphs, any_value(ocr_text) AS ocr_text FROM learn_events GROUP BY 1)"
TOKENS_SQL = """tok AS (SELECT event_id, book, page, unnest(t) AS t, generate_subscripts(t, 1) AS i FROM
  (SELECT event_id, book, page, regexp_extract_all(glyphs, (SELECT p FROM pat)) AS t FROM ev)),
seg AS (SELECT event_id, book, page, t, i, u FROM tok LEFT JOIN m ON t = k)"""

C, SIGN, V = T.CONSONANT, T.SIGN, T.VIRAMA
SUBS = T.SUBSCRIPTS


def finish_sql(text: str) -> str:
    """``finish`` in RE2, which has no look-around: what would be looked at is taken and put back."""
    out = text
    for pattern, to in (
        (f" +({SIGN}|{V})", r"\1"),
        (f"{T.HOLDER}((?:{SIGN})+)({C})", r"\2\1"),
        (f"{T.HOLDER}({SUBS})({C}(?:{V}{C})*)", r"\2\1"),
        (f"((?:{SIGN})+)({SUBS})", r"\2\1"),
        (f"({V}{T.ZWNJ})({SUBS})", r"\2\1"),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    late = f"regexp_extract_all({out}, '(?s){SUBS}|.')"
    ra, ya = T.LATE
    moved = f"""CASE WHEN length(x) > 2 THEN replace(replace(x, '{ra}', ''), '{ya}', '') || repeat('{ra}', CAST((length(x) - length(replace(x, '{ra}', ''))) // 2 AS INT))
      || repeat('{ya}', CAST((length(x) - length(replace(x, '{ya}', ''))) // 2 AS INT)) ELSE x END"""
    out = f"nfc_normalize(array_to_string(list_transform({late}, lambda x: {moved}), ''))"
    return out


def visible_sql(text: str) -> str:
    kept = f"regexp_replace({text}, '{V}({T.ZWNJ}|{C})', chr(1) || '\\1', 'g')"
    twice = f"regexp_replace({kept}, '{V}({T.ZWNJ}|{C})', chr(1) || '\\1', 'g')"
    return f"replace(replace({twice}, '{V}', '{V}{T.ZWNJ}'), chr(1), '{V}')"


def complete_sql(text: str) -> str:
    return visible_sql(f"regexp_replace({finish_sql(text)}, '{T.HOLDER}({SUBS})', '\\1', 'g')")


def comparable_sql(text: str) -> str:
    return f"replace(replace(replace({text}, '“', '‘‘'), '”', '’’'), '{T.ZWNJ}', '')"


# --- script ------------------------------------------------------------------------------------------

#: Reading order turned back into orders in which text is drawn, so that the rules have work to do.
def _drawn(text):
    mixed = F.regexp_replace(text, f"({SUBS})({SIGN})", "$2$1")
    mixed = F.regexp_replace(mixed, f"({C})({SIGN})({C})", f"$1 $2{T.HOLDER}$2$3")
    return F.replace(mixed, F.lit("ట్"), F.lit(f"ట్{T.ZWNJ}్య్ర"))


_DRAWN_SQL = rf"replace(regexp_replace(regexp_replace({{0}}, '({SUBS})({SIGN})', '\2\1', 'g'), '({C})({SIGN})({C})', '\1 \2{T.HOLDER}\2\3', 'g'), 'ట్', 'ట్{T.ZWNJ}్య్ర')"


def script_normalise(spark, sf_dir):
    text = _drawn(F.col("word"))
    return table(spark, sf_dir, "lexicon").select("word_id", T.normalise(text).alias("normalised"), T.finish(text).alias("finished"))


def script_comparable(spark, sf_dir):
    rows = table(spark, sf_dir, "word_comparisons").dropDuplicates(["wc_id"])
    return rows.select("wc_id", T.comparable(F.col("converted")).alias("comparable"), T.mark_visible_virama(F.col("converted")).alias("marked"))


def script_denormalise(spark, sf_dir):
    return table(spark, sf_dir, "lexicon").select("word_id", T.denormalise(F.col("word")).alias("drawn"))


def script_orders(spark, sf_dir):
    return table(spark, sf_dir, "lexicon").select("word_id", F.explode(T.drawing_orders(F.col("word"))).alias("variant"))


def script_syllables(spark, sf_dir):
    rows = table(spark, sf_dir, "lexicon").select(F.explode(T.syllables(F.col("word"))).alias("syllable"))
    return rows.groupBy("syllable").agg(F.count("*").alias("n"))


def script_words(spark, sf_dir):
    rows = table(spark, sf_dir, "ocr_words").where("text is not null").dropDuplicates(["book", "page", "ocr_no"])
    return rows.groupBy("book").agg(F.count_if(T.is_telugu_word(F.col("text"))).alias("telugu"), F.count_if(T.has_letter(F.col("text"))).alias("lettered"), F.count("*").alias("words"))


def book_slugs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source").distinct().select("source", T.slug(F.col("source")).alias("slug"))


def code_points(spark, sf_dir):
    return table(spark, sf_dir, "mapping_entries").select("entry_id", T.code_points(F.col("unicode")).alias("points")).distinct()


# --- glyphs ------------------------------------------------------------------------------------------


def font_families(spark, sf_dir):
    name = F.concat(F.lit("ABCDEF+"), F.col("method"), F.lit(","), F.col("entry_id"))
    rows = table(spark, sf_dir, "mapping_entries").select("entry_id", G.font_family(name).alias("family")).distinct()
    return rows.withColumn("candidate", G.is_candidate_family(F.col("family"), ("shape",)))


def font_usage(spark, sf_dir):
    """Entries per family over pages, first entry and glyph count, most used first."""
    rows = table(spark, sf_dir, "mapping_entries").dropDuplicates(["entry_id"])
    return rows.groupBy(F.col("method").alias("family")).agg(F.count("*").alias("entries"), F.min_by("glyphs", "entry_id").alias("first"), F.sum(F.length("glyphs")).alias("glyphs"))


def symbol_codes(spark, sf_dir):
    byte_chars = "".join(map(chr, range(0x20, 0x100)))
    coded = F.translate("glyph", byte_chars, "".join(map(chr, range(0xF020, 0xF100))))
    rows = table(spark, sf_dir, "glyph_stats").select("glyph").where("glyph is not null").distinct()
    return rows.select("glyph", G.symbol_decode(coded).alias("decoded"), G.symbol_encode(F.col("glyph"), byte_chars).isNotNull().alias("encodable"))


def scaled_boxes(spark, sf_dir):
    rows = occurrences(spark, sf_dir).select("book", "page", "line", "word", "position", G.scaled_box(F.col("bbox"), 0.25).alias("b"))
    return rows.select("book", "page", "line", "word", "position", *(F.col(f"b.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")))


def page_range(spark, sf_dir):
    rows = table(spark, sf_dir, "scan_pages").where(F.col("page").between(20, 40))
    return rows.dropDuplicates(["book", "page"]).groupBy("book").agg(F.count("*").alias("pages"))


def shape_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "shape_catalog").select("shape_id").distinct()
    token = G.shape_tokens(F.col("shape_id"))
    return rows.select("shape_id", G.shape_of_token(token).alias("back"), G.readable(F.concat(F.lit("x"), token)).alias("shown"))


# --- segmentation ------------------------------------------------------------------------------------


def _glyph_rows(spark, sf_dir):
    """Glyphs of the pages' components: a row is a line, narrow boxes are marks, the band 'above' is other type."""
    rows = occurrences(spark, sf_dir)
    pos = F.col("word") * 100 + F.col("position")
    return rows.select("book", "page", "line", pos.alias("pos"), F.coalesce(F.col("shape_id").cast("string"), F.lit(" ")).alias("char"), (F.coalesce("band", F.lit("above")) != "above").alias("is_legacy"), (F.col("bbox.x1") - F.col("bbox.x0") - 30).cast("double").alias("width"), F.col("bbox").alias("box"))


_GLYPH_SQL = """g AS (SELECT DISTINCT book, page, line, word * 100 + position AS pos, coalesce(CAST(shape_id AS VARCHAR), ' ') AS char,
  coalesce(band, 'above') <> 'above' AS is_legacy, CAST(bbox.x1 - bbox.x0 - 30 AS DOUBLE) AS width, bbox AS box FROM occurrences)"""
_LINE_W = "PARTITION BY book, page, line ORDER BY pos"


def word_split(spark, sf_dir):
    words = S.split_words(_glyph_rows(spark, sf_dir), ["book", "page", "line"])
    return words.groupBy("book", "page", "line", "word").agg(S.joined("char", "pos").alias("text"), F.count("*").alias("glyphs"))


def word_units(spark, sf_dir):
    found = S.words_of(_glyph_rows(spark, sf_dir), ["book", "page", "line"])
    return found.select("book", "page", "line", "word", "text", F.array_join("units", "|").alias("units"), "box.x0", "box.y0", "box.x1", "box.y1")


def script_runs(spark, sf_dir):
    runs = S.script_runs(_glyph_rows(spark, sf_dir), ["book", "page", "line"])
    return runs.groupBy("book", "page", "line", "run", "is_legacy").agg(F.count("*").alias("glyphs"))


def baseline_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "ocr_words").dropDuplicates(["book", "page", "ocr_no"]).select("book", "page", "ocr_no", F.col("bbox.y1").alias("baseline"))
    return S.baseline_rows(rows, ["book", "page"], "baseline", ["ocr_no"]).select("book", "page", "ocr_no", "row")


def scan_words(spark, sf_dir):
    rows = S.scan_words(occurrences(spark, sf_dir), ["book", "page"])
    return rows.select("book", "page", "line", "word", F.array_join("shape_ids", " ", "?").alias("ids"), "box.x0", "box.x1")


# --- transcoding -------------------------------------------------------------------------------------


def transcode_segments(spark, sf_dir):
    rows = TR.with_segments(events(spark, sf_dir).select("event_id", "glyphs"), "glyphs", mapping_of(spark, sf_dir, METHODS[1]))
    return rows.select("event_id", TR.raw_text(F.col("segments")).alias("raw"), TR.glyph_count(F.col("segments")).alias("glyphs"), TR.gap_length(F.col("segments")).alias("unmapped"))


def transcode_text(spark, sf_dir):
    rows = TR.with_segments(events(spark, sf_dir).select("event_id", "glyphs"), "glyphs", mapping_of(spark, sf_dir, METHODS[0]))
    return rows.select("event_id", TR.render(F.col("segments")).alias("text"))


def transcode_documents(spark, sf_dir):
    """How much of every document's whole text the mapping covers; legacy-coded ones stand out."""
    rows = table(spark, sf_dir, "documents").dropDuplicates(["doc_id"]).select("doc_id", "text")
    done = TR.with_segments(rows, "text", mapping_of(spark, sf_dir, METHODS[0]))
    return done.select("doc_id", TR.glyph_count(F.col("segments")).alias("glyphs"), TR.gap_length(F.col("segments")).alias("unmapped"))


def transcode_coverage(spark, sf_dir):
    rows = TR.with_segments(events(spark, sf_dir).select("book", "page_number", "glyphs"), "glyphs", mapping_of(spark, sf_dir, METHODS[1]))
    return TR.coverage(rows, "segments", ["book", "page_number"]).withColumn("ratio", F.round("ratio", 6))


def unmapped_report(spark, sf_dir):
    rows = TR.with_segments(events(spark, sf_dir).select("glyphs"), "glyphs", mapping_of(spark, sf_dir, METHODS[1]))
    return TR.unmapped_report(rows, "segments")


def transcode_by_join(spark, sf_dir):
    source = table(spark, sf_dir, "mapping_entries").where(F.col("method") == METHODS[1])
    rows = TR.segments_by_join(events(spark, sf_dir).select("event_id", "glyphs"), "event_id", "glyphs", source)
    return rows.select("event_id", TR.raw_text(F.col("segments")).alias("raw"), TR.glyph_count(F.col("segments")).alias("glyphs"), TR.gap_length(F.col("segments")).alias("unmapped"))


def convert_lines(spark, sf_dir):
    """Lines of a page from runs: every second run is other type and passes through."""
    rows = events(spark, sf_dir).where("glyphs is not null").select("book", "page_number", "event_id", "glyphs", (F.col("event_id") % 2 == 0).alias("is_legacy"))
    runs = rows.select("book", "page_number", F.col("event_id").alias("run"), F.col("glyphs").alias("text"), "is_legacy")
    return TR.convert_runs(runs, ["book", "page_number"], mapping_of(spark, sf_dir, METHODS[1]))


def page_texts(spark, sf_dir):
    lines = table(spark, sf_dir, "scan_pages").dropDuplicates(["book", "page"]).select("book", "page", F.posexplode("lines").alias("line_no", "text"))
    return TR.pages_of(lines, ["book", "page"])


def _names(spark, sf_dir):
    """Names of shapes as the atlas proposes them, one per shape."""
    rows = table(spark, sf_dir, "atlas_rows").where("proposal <> ''")
    return rows.groupBy("shape_id").agg(F.min("proposal").alias("unicode"))


def scan_transcode(spark, sf_dir):
    words = S.scan_words(occurrences(spark, sf_dir).where("shape_id is not null"), ["book", "page"])
    done = TR.scan_transcode(words, _names(spark, sf_dir), ["book", "page", "line", "word"])
    return done.select("book", "page", "line", "word", "text", "glyphs", F.size("unmapped").alias("missing"))


def scan_unmapped(spark, sf_dir):
    words = S.scan_words(occurrences(spark, sf_dir).where("shape_id is not null"), ["book", "page"])
    return TR.unmapped_ids(TR.scan_transcode(words, _names(spark, sf_dir), ["book", "page", "line", "word"]))


QUERIES = {
    f.__name__: f
    for f in (
        script_normalise, script_comparable, script_denormalise, script_orders, script_syllables, script_words, book_slugs, code_points,
        font_families, font_usage, symbol_codes, scaled_boxes, page_range, shape_tokens, word_split, word_units, script_runs, baseline_rows, scan_words,
        transcode_segments, transcode_text, transcode_documents, transcode_coverage, unmapped_report, transcode_by_join, convert_lines, page_texts, scan_transcode, scan_unmapped,
    )
}

_SEGMENTS = "WITH " + MAP_SQL.format(method=METHODS[1]) + ", " + EVENTS_SQL + ", " + TOKENS_SQL
_RAW = "replace(string_agg(CASE WHEN u IS NULL THEN '⟦' || t || '⟧' WHEN u = '' THEN chr(2) ELSE u END, '' ORDER BY i), '⟧⟦', '')"
_EV_SUMS = """coalesce(sum(CASE WHEN t <> ' ' THEN length(t) END), 0) AS glyphs, coalesce(sum(CASE WHEN u IS NULL THEN length(t) END), 0) AS unmapped"""
_SEG_SQL = _SEGMENTS + f""" SELECT ev.event_id, coalesce(replace(r, chr(2), ''), CASE WHEN ev.glyphs IS NOT NULL THEN '' END) AS raw,
  CASE WHEN ev.glyphs IS NOT NULL THEN CAST(coalesce(x.glyphs, 0) AS BIGINT) END AS glyphs, CASE WHEN ev.glyphs IS NOT NULL THEN CAST(coalesce(x.unmapped, 0) AS BIGINT) END AS unmapped
  FROM ev LEFT JOIN (SELECT event_id, {_RAW} AS r, {_EV_SUMS} FROM seg GROUP BY 1) x USING (event_id)"""
_NAMES_SQL = "nm AS (SELECT shape_id, min(proposal) AS unicode FROM atlas_rows WHERE proposal <> '' GROUP BY 1), oc AS (SELECT DISTINCT book, page, line, word, position, shape_id FROM occurrences WHERE shape_id IS NOT NULL)"

ORACLE = {
    # of the lexicon's letters canonical decomposition parts one only; the lookahead is a class without ర
    "script_orders": rf"""WITH a AS (SELECT word_id, unnest([word, replace(word, chr(3144), chr(3142) || chr(3158))]) AS v FROM lexicon),
b AS (SELECT * FROM a UNION ALL SELECT word_id, regexp_replace(v, '({C}(?:{V}[క-యఱ-హౘ-ౚ])*)({V}ర)', '{T.HOLDER}\2\1', 'g') FROM a),
c AS (SELECT * FROM b UNION ALL SELECT word_id, regexp_replace(v, '({SUBS})({SIGN})', '\2\1', 'g') FROM b) SELECT DISTINCT word_id, v AS variant FROM c""",
    "script_normalise": f"SELECT DISTINCT word_id, {finish_sql(_DRAWN_SQL.format('word'))} AS normalised, {complete_sql(_DRAWN_SQL.format('word'))} AS finished FROM lexicon",
    "script_comparable": f"SELECT DISTINCT wc_id, {comparable_sql('converted')} AS comparable, {visible_sql('converted')} AS marked FROM word_comparisons",
    "script_denormalise": rf"SELECT word_id, regexp_replace(word, '({SUBS})({SIGN})', '\2\1', 'g') AS drawn FROM lexicon",
    "script_syllables": f"SELECT s AS syllable, count(*) AS n FROM (SELECT unnest(regexp_extract_all(word, '{T.SYLLABLE}')) AS s FROM lexicon) GROUP BY 1",
    "script_words": """WITH w AS (SELECT DISTINCT book, page, ocr_no, text FROM ocr_words WHERE text IS NOT NULL)
SELECT book, count(*) FILTER (regexp_full_match(text, '[ఀ-౿.,;:!?()''"-]+')) AS telugu, count(*) FILTER (regexp_matches(text, '[ఀ-౿]')) AS lettered, count(*) AS words FROM w GROUP BY 1""",
    "book_slugs": "SELECT DISTINCT source, trim(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents",
    "code_points": """SELECT DISTINCT entry_id, array_to_string(list_transform(regexp_extract_all(unicode, '(?s).'), lambda c: 'U+' || lpad(to_hex(unicode(c)), CAST(greatest(4, length(to_hex(unicode(c)))) AS INT), '0')), ' ') AS points FROM mapping_entries""",
    "font_families": "SELECT DISTINCT entry_id, method AS family, method NOT LIKE '%shape%' AS candidate FROM mapping_entries",
    "font_usage": """WITH e AS (SELECT DISTINCT entry_id, glyphs, method FROM mapping_entries)
SELECT method AS family, count(*) AS entries, arg_min(glyphs, entry_id) AS first, CAST(sum(length(glyphs)) AS BIGINT) AS glyphs FROM e GROUP BY 1""",
    "symbol_codes": "SELECT DISTINCT glyph, glyph AS decoded, unicode(glyph) BETWEEN 32 AND 255 AS encodable FROM glyph_stats WHERE glyph IS NOT NULL",
    "scaled_boxes": "SELECT DISTINCT book, page, line, word, position, bbox.x0 * 0.25::DOUBLE AS x0, bbox.y0 * 0.25::DOUBLE AS y0, bbox.x1 * 0.25::DOUBLE AS x1, bbox.y1 * 0.25::DOUBLE AS y1 FROM occurrences",
    "page_range": "SELECT book, count(DISTINCT page) AS pages FROM scan_pages WHERE page BETWEEN 20 AND 40 GROUP BY 1",
    "shape_tokens": "SELECT DISTINCT shape_id, shape_id AS back, 'x#' || shape_id AS shown FROM shape_catalog",
    "word_split": f"""WITH {_GLYPH_SQL}, k AS (SELECT *, is_legacy AND char <> ' ' AS keep FROM g),
b AS (SELECT *, CASE WHEN keep AND NOT coalesce(lag(keep) OVER ({_LINE_W}), false) THEN 1 ELSE 0 END AS begins FROM k),
w AS (SELECT *, sum(begins) OVER ({_LINE_W}) AS word FROM b)
SELECT book, page, line, CAST(word AS INT) AS word, string_agg(char, '' ORDER BY pos) AS text, count(*) AS glyphs FROM w WHERE keep GROUP BY 1, 2, 3, 4""",
    "word_units": f"""WITH {_GLYPH_SQL}, k AS (SELECT *, is_legacy AND char <> ' ' AS keep FROM g),
b AS (SELECT *, CASE WHEN keep AND NOT coalesce(lag(keep) OVER ({_LINE_W}), false) THEN 1 ELSE 0 END AS begins FROM k),
w AS (SELECT *, sum(begins) OVER ({_LINE_W}) AS word FROM b),
u AS (SELECT *, sum(CASE WHEN width >= 0.5 OR begins = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY book, page, line, word ORDER BY pos) AS unit FROM w WHERE keep),
t AS (SELECT book, page, line, word, unit, string_agg(char, '' ORDER BY pos) AS text, min(box.x0) AS x0, min(box.y0) AS y0, max(box.x1) AS x1, max(box.y1) AS y1 FROM u GROUP BY ALL)
SELECT book, page, line, CAST(word AS INT) AS word, string_agg(text, '' ORDER BY unit) AS text, string_agg(text, '|' ORDER BY unit) AS units, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM t GROUP BY 1, 2, 3, 4""",
    "script_runs": f"""WITH {_GLYPH_SQL}, c AS (SELECT *, CASE WHEN lag(is_legacy) OVER ({_LINE_W}) IS DISTINCT FROM is_legacy THEN 1 ELSE 0 END AS c FROM g),
r AS (SELECT *, CAST(sum(c) OVER ({_LINE_W}) AS INT) AS run FROM c) SELECT book, page, line, run, is_legacy, count(*) AS glyphs FROM r GROUP BY ALL""",
    "baseline_rows": """WITH RECURSIVE w AS (SELECT book, page, ocr_no, any_value(bbox.y1) AS b FROM ocr_words GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (PARTITION BY book, page ORDER BY b, ocr_no) AS i FROM w),
r AS (SELECT book, page, ocr_no, i, b AS anchor, 1 AS row FROM n WHERE i = 1 UNION ALL
  SELECT n.book, n.page, n.ocr_no, n.i, CASE WHEN n.b - r.anchor > 2.0 THEN n.b ELSE r.anchor END, CASE WHEN n.b - r.anchor > 2.0 THEN r.row + 1 ELSE r.row END
  FROM r JOIN n ON n.book = r.book AND n.page = r.page AND n.i = r.i + 1) SELECT book, page, ocr_no, row FROM r""",
    "scan_words": """WITH o AS (SELECT DISTINCT book, page, line, word, position, shape_id, bbox FROM occurrences)
SELECT book, page, line, word, string_agg(coalesce(CAST(shape_id AS VARCHAR), '?'), ' ' ORDER BY position) AS ids, min(bbox.x0) AS x0, max(bbox.x1) AS x1 FROM o GROUP BY 1, 2, 3, 4""",
    "transcode_segments": _SEG_SQL,
    "transcode_by_join": _SEG_SQL,
    "transcode_text": "WITH " + MAP_SQL.format(method=METHODS[0]) + ", " + EVENTS_SQL + ", " + TOKENS_SQL + f", r AS (SELECT event_id, replace({_RAW}, chr(2), '') AS r FROM seg GROUP BY 1) SELECT ev.event_id, {complete_sql('r.r')} AS text FROM ev LEFT JOIN r USING (event_id)",
    "transcode_documents": "WITH " + MAP_SQL.format(method=METHODS[0]) + """, d AS (SELECT doc_id, any_value(text) AS text FROM documents GROUP BY 1),
tok AS (SELECT doc_id, unnest(regexp_extract_all(text, (SELECT p FROM pat))) AS t FROM d), seg AS (SELECT doc_id, t, u FROM tok LEFT JOIN m ON t = k)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN CAST(coalesce(x.glyphs, 0) AS BIGINT) END AS glyphs, CASE WHEN d.text IS NOT NULL THEN CAST(coalesce(x.unmapped, 0) AS BIGINT) END AS unmapped
FROM d LEFT JOIN (SELECT doc_id, """ + _EV_SUMS + " FROM seg GROUP BY 1) x USING (doc_id)",
    "transcode_coverage": _SEGMENTS + f""" SELECT book, page AS page_number, CAST(glyphs AS BIGINT) AS glyphs, CAST(unmapped AS BIGINT) AS unmapped,
  round(CASE WHEN glyphs > 0 THEN 1 - unmapped / glyphs ELSE 1.0 END, 6) AS ratio FROM (SELECT ev.book, ev.page, {_EV_SUMS} FROM ev LEFT JOIN seg ON seg.event_id = ev.event_id AND ev.glyphs IS NOT NULL GROUP BY 1, 2)""",
    "unmapped_report": _SEGMENTS + """, b AS (SELECT *, CASE WHEN u IS NULL AND lag(u IS NULL) OVER (PARTITION BY event_id ORDER BY i) IS NOT TRUE THEN 1 ELSE 0 END AS c FROM seg),
r AS (SELECT *, sum(c) OVER (PARTITION BY event_id ORDER BY i) AS gap FROM b), x AS (SELECT event_id, gap, string_agg(t, '' ORDER BY i) AS glyphs FROM r WHERE u IS NULL GROUP BY 1, 2)
SELECT glyphs, count(*) AS count FROM x GROUP BY 1""",
    "convert_lines": _SEGMENTS + f""", r AS (SELECT event_id, replace({_RAW}, chr(2), '') AS r FROM seg GROUP BY 1)
SELECT ev.book, ev.page AS page_number, string_agg(CASE WHEN ev.event_id % 2 = 0 THEN coalesce({complete_sql('r.r')}, '') ELSE ev.glyphs END, '' ORDER BY ev.event_id) AS text FROM ev LEFT JOIN r USING (event_id) WHERE ev.glyphs IS NOT NULL GROUP BY 1, 2""",
    "page_texts": """WITH p AS (SELECT book, page, any_value(lines) AS lines FROM scan_pages GROUP BY 1, 2)
SELECT book, page, array_to_string(list_filter(lines, lambda x: x IS NOT NULL), chr(10)) AS text FROM p WHERE len(lines) > 0""",
    "scan_transcode": "WITH " + _NAMES_SQL + f""", t AS (SELECT book, page, line, word, replace(string_agg(coalesce(unicode, '⟦#' || oc.shape_id || '⟧'), '' ORDER BY position), '⟧⟦', '') AS raw,
  count(*) AS glyphs, CAST(count(*) FILTER (unicode IS NULL) AS INT) AS missing FROM oc LEFT JOIN nm USING (shape_id) GROUP BY 1, 2, 3, 4) SELECT book, page, line, word, {complete_sql('raw')} AS text, glyphs, missing FROM t""",
    "scan_unmapped": "WITH " + _NAMES_SQL + " SELECT oc.shape_id, count(*) AS count FROM oc LEFT JOIN nm USING (shape_id) WHERE unicode IS NULL GROUP BY 1",
}
