"""Queries of the whole page pipeline: raw pages to glyphs, rows, words and text, with their SQL.

Raw pages are laid out from the words of ``learn_events``: a word is a piece of a line with one span, every
seventh in another font and every eleventh in one that can't be decoded; baselines are 40 points apart and up
to 1.8 points off.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lipimala.functions.glyphs import characters
from lipimala.operators import segment as S
from lipimala.operators import transcode as TR
from lipimala.operators.quality import page_changes
from lipimala.plans.measure_queries import distance_sql, letters_sql, words_sql
from lipimala.plans.text_queries import EVENTS_SQL, MAP_SQL, METHODS, _RAW, complete_sql, events, mapping_of
from lipimala.runtime import table
from lipimala.sources import pages

# Bytes whose characters the font changes.
OVERRIDES = {"C6": "Δ", "D0": "-", "DB": "¤"}
PROFILE = {"fonts": ["Old"], "ascent": 0.75, "descent": 0.35, "byte_encoding": "mac_roman", "byte_overrides": OVERRIDES}


def raw_pages(spark, sf_dir):
    """Nested pages (page, fonts, blocks) as an extractor gives them."""
    words = events(spark, sf_dir).where("glyphs <> ''").select("event_id", F.concat_ws(":", "book", F.col("page_number").cast("string")).alias("page"), "bbox", "glyphs")
    base = (F.round(F.col("bbox.y1") / 40) * 40 + (F.col("event_id") % 3) * 0.9).cast("double")
    step = (F.col("bbox.x1") - F.col("bbox.x0")) / F.length("glyphs")
    name = F.when(F.col("event_id") % 11 == 0, "ABCDEF+Drawn").when(F.col("event_id") % 7 == 0, "ABCDEF+Plain,Bold").otherwise("ABCDEF+Old")
    box = lambda x0, x1: F.struct(x0.alias("x0"), (base - 8.0).alias("y0"), x1.alias("x1"), (base + 2.0).alias("y1"))
    at = lambda i: F.col("bbox.x0") + step * i
    chars = F.transform(characters(F.col("glyphs")), lambda c, i: F.struct(c.alias("c"), box(at(i), at(i + 1)).alias("bbox"), F.array(at(i), base).alias("origin")))
    span = F.struct(name.alias("font"), F.lit(10.0).alias("size"), F.array(F.col("bbox.x0"), base).alias("origin"), chars.alias("chars"))
    line = F.struct(box(F.col("bbox.x0"), F.col("bbox.x1")).alias("bbox"), F.array(span).alias("spans"))
    blocks = words.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: F.struct(F.array(x["line"]).alias("lines"))).alias("blocks"))
    font = lambda xref, kind, family: F.struct(F.lit(xref).alias("xref"), F.lit(kind).alias("kind"), F.lit(family).alias("name"))
    return blocks.withColumn("fonts", F.array(font(1, "TrueType", "ABCDEF+Old"), font(2, "Type3", "ABCDEF+Drawn"), font(3, "TrueType", "ABCDEF+Plain,Bold")))


def _glyphs(spark, sf_dir):
    source = raw_pages(spark, sf_dir)
    fonts = pages.page_fonts(source)
    chars = pages.without_type3(pages.raw_characters(source), fonts)
    glyphs = pages.decoded(chars, fonts, PROFILE)
    return S.joined_rows(glyphs.withColumn("left", F.col("line_box.x0")), ["page"], ["block_no", "line_no"], order="char_no")


def page_glyph_rows(spark, sf_dir):
    """The rows of every page as read: pieces from left to right with blanks between them."""
    rows = _glyphs(spark, sf_dir)
    return rows.groupBy("page", "row").agg(S.joined("char", "pos").alias("text"), F.sum(F.col("is_legacy").cast("int")).cast("int").alias("legacy"), F.round(F.max("box.y1") - F.min("box.y0"), 4).alias("height"))


def page_words(spark, sf_dir):
    """The legacy words of every row."""
    return S.words_of(_glyphs(spark, sf_dir), ["page", "row"]).select("page", "row", "word", "text", F.round("box.x0", 4).alias("x0"), F.round("box.x1", 4).alias("x1"))


def page_conversion(spark, sf_dir):
    """Pages as text: runs of legacy glyphs transcoded, others as they are, rows one below the other."""
    runs = S.script_runs(_glyphs(spark, sf_dir), ["page", "row"]).groupBy("page", "row", "run", "is_legacy").agg(S.joined("char", "pos").alias("text"))
    lines = TR.convert_runs(runs, ["page", "row"], mapping_of(spark, sf_dir, METHODS[1]))
    return TR.pages_of(lines, ["page"], order="row")


def page_fonts_used(spark, sf_dir):
    """Families over all pages: entries and the first page's reference."""
    return pages.font_usage(pages.page_fonts(raw_pages(spark, sf_dir)))


def canonical_glyphs(spark, sf_dir):
    """Every character of the mapping's glyphs: its byte and what it is canonically."""
    codec = pages.codec_of(PROFILE)
    each = table(spark, sf_dir, "mapping_entries").select(F.explode(characters(F.col("glyphs"))).alias("char")).distinct()
    return each.select("char", codec.byte_of(F.col("char")).alias("byte"), codec.canonical(F.col("char")).alias("canonical"))


def output_diff(spark, sf_dir):
    """Word and character error rates of the readings of a page against its conversion."""
    rows = table(spark, sf_dir, "word_comparisons").dropDuplicates(["wc_id"]).where("converted is not null")
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("wc_id", c))), lambda x: F.coalesce(x[c], F.lit(""))), " ").alias(c)
    both = rows.groupBy("book", "page").agg(joined("converted"), joined("ocr"))
    found = page_changes(both, "converted", "ocr")
    return found.select("book", "page", "before_words", F.round("word_error_rate", 6).alias("word_error_rate"), F.round("character_error_rate", 6).alias("character_error_rate"))


QUERIES = {q.__name__: q for q in (page_glyph_rows, page_words, page_conversion, page_fonts_used, canonical_glyphs, output_diff)}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    plain = {int(b, 16): bytes([int(b, 16)]).decode("mac_roman") for b in OVERRIDES}
    for b, c in OVERRIDES.items():
        text = f"replace({text}, {_quoted(plain[int(b, 16)])}, {_quoted(c)})"
    return text


_ROWS_SQL = "WITH RECURSIVE " + EVENTS_SQL.replace("any_value(glyphs) AS glyphs", "any_value(glyphs) AS glyphs, any_value(bbox) AS bbox") + f""",
p AS (SELECT book || ':' || page AS page, event_id, bbox, glyphs, round(bbox.y1 / 40) * 40 + (event_id % 3) * 0.9 AS b, event_id % 7 <> 0 AS legacy,
  CASE WHEN event_id % 7 <> 0 THEN {_canonical_sql('glyphs')} ELSE glyphs END AS shown FROM ev WHERE glyphs <> '' AND event_id % 11 <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY b, event_id) AS i FROM p),
r AS (SELECT page, event_id, i, b AS anchor, 1 AS row FROM n WHERE i = 1 UNION ALL
  SELECT n.page, n.event_id, n.i, CASE WHEN n.b - r.anchor > 2.0 THEN n.b ELSE r.anchor END, CASE WHEN n.b - r.anchor > 2.0 THEN r.row + 1 ELSE r.row END
  FROM r JOIN n ON n.page = r.page AND n.i = r.i + 1),
q AS (SELECT n.*, r.row, row_number() OVER (PARTITION BY n.page, r.row ORDER BY n.bbox.x0, n.b, n.event_id) AS nth FROM n JOIN r USING (page, event_id)),
f AS (SELECT *, max(CASE WHEN legacy THEN b + 3.5 ELSE b + 2.0 END) OVER w - min(CASE WHEN legacy THEN b - 7.5 ELSE b - 8.0 END) OVER w AS height FROM q WINDOW w AS (PARTITION BY page, row))
"""

ORACLE = {
    "page_glyph_rows": _ROWS_SQL + "SELECT page, row, string_agg(shown, ' ' ORDER BY nth) AS text, CAST(sum(CASE WHEN legacy THEN length(shown) ELSE 0 END) AS INT) AS legacy, round(any_value(height), 4) AS height FROM f GROUP BY 1, 2",
    "page_words": _ROWS_SQL + """, c AS (SELECT page, row, nth, bbox, length(shown) AS n, unnest(string_split_regex(shown, '')) AS c, generate_subscripts(string_split_regex(shown, ''), 1) AS i FROM q WHERE legacy),
k AS (SELECT *, CASE WHEN c <> ' ' AND coalesce(lag(c) OVER (PARTITION BY page, row, nth ORDER BY i), ' ') = ' ' THEN 1 ELSE 0 END AS b FROM c),
w AS (SELECT *, sum(b) OVER (PARTITION BY page, row ORDER BY nth, i) AS word FROM k)
SELECT page, row, CAST(word AS INT) AS word, string_agg(c, '' ORDER BY i) AS text, round(min(bbox.x0 + (bbox.x1 - bbox.x0) / n * (i - 1)), 4) AS x0, round(max(bbox.x0 + (bbox.x1 - bbox.x0) / n * i), 4) AS x1 FROM w WHERE c <> ' ' GROUP BY 1, 2, 3""",
    "page_conversion": _ROWS_SQL.rstrip() + ", " + MAP_SQL.format(method=METHODS[1]) + f""",
tok AS (SELECT page, row, nth, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM (SELECT page, row, nth, regexp_extract_all(shown, (SELECT p FROM pat)) AS ts FROM q WHERE legacy)),
seg AS (SELECT page, row, nth, t, i, u FROM tok LEFT JOIN m ON t = k),
x AS (SELECT page, row, nth, replace({_RAW}, chr(2), '') AS r FROM seg GROUP BY 1, 2, 3),
l AS (SELECT q.page, q.row, string_agg(CASE WHEN legacy THEN coalesce({complete_sql('x.r')}, '') ELSE shown END, ' ' ORDER BY nth) AS text FROM q LEFT JOIN x USING (page, row, nth) GROUP BY 1, 2)
SELECT page, string_agg(text, chr(10) ORDER BY row) AS text FROM l GROUP BY 1""",
    "output_diff": f"""WITH s AS (SELECT wc_id, any_value(book) AS book, any_value(page) AS page, any_value(converted) AS converted, any_value(ocr) AS ocr FROM word_comparisons GROUP BY 1),
t AS (SELECT book, page, string_agg(converted, ' ' ORDER BY wc_id) AS a, string_agg(coalesce(ocr, ''), ' ' ORDER BY wc_id) AS b FROM s WHERE converted IS NOT NULL GROUP BY 1, 2),
w AS (SELECT book, page, {words_sql('a')} AS a, {words_sql('b')} AS b FROM t), l AS (SELECT *, {letters_sql("array_to_string(a, '')")} AS al, {letters_sql("array_to_string(b, '')")} AS bl FROM w)
SELECT book, page, CAST(len(a) AS INT) AS before_words, round(coalesce({distance_sql('a', 'b')} / nullif(len(a), 0), 0), 6) AS word_error_rate, round(coalesce({distance_sql('al', 'bl')} / nullif(len(al), 0), 0), 6) AS character_error_rate FROM l""",
    "page_fonts_used": """WITH p AS (SELECT count(DISTINCT (book, page_number)) AS n FROM learn_events WHERE glyphs <> '')
SELECT family, n AS entries, xref FROM p, (VALUES ('Old', 1), ('Drawn', 2), ('Plain', 3)) f(family, xref) WHERE n > 0""",
    "canonical_glyphs": f"""WITH t(byte, c) AS (VALUES {', '.join(f'({b}, {_quoted(bytes([b]).decode("mac_roman"))})' for b in range(1, 256))}),
o(byte, c) AS (VALUES {', '.join(f'({int(b, 16)}, {_quoted(c)})' for b, c in OVERRIDES.items())}),
d AS (SELECT DISTINCT unnest(string_split_regex(glyphs, '')) AS char FROM mapping_entries)
SELECT char, coalesce(o.byte, t.byte) AS byte, coalesce(o.c, o2.c, t.c, nfc_normalize(char)) AS canonical
FROM d LEFT JOIN o ON o.c = char LEFT JOIN t ON t.c = char LEFT JOIN o o2 ON o2.byte = t.byte WHERE char <> ''""",
}
