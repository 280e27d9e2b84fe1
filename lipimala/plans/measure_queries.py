"""Queries of matching, quality, mapping comparison and alphabet statistics, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lipimala.functions import glyphs as G
from lipimala.operators import alphabet as A
from lipimala.operators import compare as C
from lipimala.operators import match as M
from lipimala.operators import quality as Q
from lipimala.plans.text_queries import EVENTS_SQL, MAP_SQL, METHODS, _RAW, comparable_sql, complete_sql, events, mapping_of, occurrences
from lipimala.runtime import maybe_broadcast, table


def comparisons(spark, sf_dir):
    return table(spark, sf_dir, "word_comparisons").dropDuplicates(["wc_id"])


WC_SQL = "wc AS (SELECT wc_id, any_value(book) AS book, any_value(page) AS page, any_value(bbox) AS bbox, any_value(converted) AS converted, any_value(ocr) AS ocr, any_value(confidence) AS confidence FROM word_comparisons GROUP BY 1)"

# --- matching ----------------------------------------------------------------------------------------


def _sides(spark, sf_dir):
    words = comparisons(spark, sf_dir).select("book", "page", "wc_id", F.col("bbox").alias("box"), "converted")
    ocr = table(spark, sf_dir, "word_comparisons").where("ocr_bbox is not null and ocr is not null").dropDuplicates(["wc_id"])
    return words, ocr.select("book", "page", F.col("wc_id").alias("ocr_no"), F.col("ocr").alias("ocr_text"), F.col("ocr_bbox").alias("ocr_box"))


def spatial_best_match(spark, sf_dir):
    found = M.best_matches(*_sides(spark, sf_dir), ["book", "page"], ["wc_id"], "ocr_no")
    return found.select("wc_id", "ocr_no", F.round("overlap", 6).alias("overlap"))


def spatial_compare(spark, sf_dir):
    found = M.compare_words(*_sides(spark, sf_dir), ["book", "page"], ["wc_id"], "ocr_no")
    return found.groupBy("book").agg(F.count("*").alias("words"), F.count("ocr_no").alias("matched"))


def learning_observations(spark, sf_dir):
    found = M.observations(*_sides(spark, sf_dir), ["book", "page"], ["wc_id"], "ocr_no")
    return found.select("wc_id", "ocr_text")


# --- quality -----------------------------------------------------------------------------------------


def quality_by_page(spark, sf_dir):
    pages = Q.with_total(Q.page_quality(comparisons(spark, sf_dir), ["book", "page"]), ["book"])
    return Q.rates(pages).select("book", "page", "words", "matched", "disagreements", "unresolved", "unmatched", "agreements", *(F.round(c, 4).alias(c) for c in ("agreement_rate", "mean_confidence_agreeing", "mean_confidence_disagreeing")))


def confusions(spark, sf_dir):
    return Q.confusions(comparisons(spark, sf_dir))


def edit_distances(spark, sf_dir):
    rows = comparisons(spark, sf_dir).where("ocr is not null and converted is not null")
    a, b = F.split("converted", "(?<=[ -])"), F.split("ocr", "(?<=[ -])")
    chars = G.edit_distance(G.characters(F.col("converted")), G.characters(F.col("ocr")))
    return rows.select("wc_id", F.levenshtein("converted", "ocr").alias("characters"), (chars == F.levenshtein("converted", "ocr")).alias("agrees"), G.edit_distance(a, b).alias("words"))


def ground_truth(spark, sf_dir):
    """Pages' conversions and readings against a proofread text: the reading where it is sure, else the conversion."""
    rows = comparisons(spark, sf_dir).where("converted is not null").withColumn("proof", F.when(F.col("confidence") >= 80, F.coalesce("ocr", "converted")).otherwise(F.col("converted")))
    pages = rows.groupBy("book", "page").agg(*(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("wc_id", F.coalesce(c, F.lit("")).alias("t")))), lambda x: x["t"]), " ").alias(c) for c in ("proof", "converted", "ocr")))
    truth = Q.ground_truth(pages, "proof", "converted", "ocr")
    return truth.select("book", "page", "reference_words", "converted_word_errors", "ocr_word_errors", *(F.round(c, 6).alias(c) for c in ("converted_wer", "converted_cer", "ocr_wer", "ocr_cer")))


def ground_truth_total(spark, sf_dir):
    found = Q.overall(ground_truth(spark, sf_dir))
    return found.withColumn("ocr_wer", F.round("ocr_wer", 6)).withColumn("converted_wer", F.round("converted_wer", 6))


def output_changes(spark, sf_dir):
    return Q.word_changes(comparisons(spark, sf_dir), "converted", "ocr")


# --- comparison of mappings --------------------------------------------------------------------------


def _compared(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "page_number", "glyphs", "ocr_text")
    return C.convert_both(rows, "glyphs", mapping_of(spark, sf_dir, METHODS[1]), mapping_of(spark, sf_dir, METHODS[0]))


def mapping_diff(spark, sf_dir):
    found = C.differences(_compared(spark, sf_dir), "glyphs", "ocr_text", F.struct("page_number", "event_id"))
    return C.report_order(found).select("glyphs", "candidate", "reference", "count", "candidate_votes", "reference_votes", "verdict", F.col("first.page_number").alias("first_page"))


def mapping_verdicts(spark, sf_dir):
    return C.summary(mapping_diff(spark, sf_dir))


def entry_conflicts(spark, sf_dir):
    """Glyph sequences to which methods give different texts."""
    rows = table(spark, sf_dir, "mapping_entries").dropDuplicates(["entry_id"])
    return rows.groupBy("glyphs").agg(F.count_distinct("unicode").alias("texts"), F.count("*").alias("entries")).where("texts > 1")


def glyph_names(spark, sf_dir):
    names = table(spark, sf_dir, "mapping_entries").where("length(glyphs) = 1").groupBy(F.col("glyphs").alias("glyph")).agg(F.min("unicode").alias("name"))
    rows = table(spark, sf_dir, "mapping_entries").select("entry_id", "glyphs").distinct()
    return C.shape_names(rows, "glyphs", names).select("entry_id", "shapes")


# --- alphabet ----------------------------------------------------------------------------------------

_ORDER = ["page", "line", "word", "position"]


def shape_ranking(spark, sf_dir):
    return A.shape_ranking(occurrences(spark, sf_dir), ["book"], _ORDER, 2)


def alphabet_stats(spark, sf_dir):
    counts = occurrences(spark, sf_dir).where("shape_id is not null").groupBy("book", "shape_id").agg(F.count("*").alias("count"))
    return A.alphabet_stats(counts, ["book"])


def alphabet_growth(spark, sf_dir):
    return A.growth(occurrences(spark, sf_dir), ["book"])


def systematic_sample(spark, sf_dir):
    rows = occurrences(spark, sf_dir).where("shape_id is not null").select("book", "shape_id", *_ORDER)
    return A.systematic_sample(rows, ["book", "shape_id"], _ORDER, 5)


def member_sample(spark, sf_dir):
    rows = occurrences(spark, sf_dir).where("shape_id is not null").select("book", "shape_id", *_ORDER)
    return A.member_sample(rows, ["shape_id"], ["book", *_ORDER]).groupBy("shape_id").agg(F.count("*").alias("members"))


def majority_reading(spark, sf_dir):
    rows = events(spark, sf_dir).select("glyphs", "ocr_text", "event_id")
    return A.majority(rows, ["glyphs"], "ocr_text", "event_id")


def glyph_statistics(spark, sf_dir):
    words = events(spark, sf_dir).select("book", "glyphs", F.col("event_id").alias("seq"))
    return A.glyph_stats(words, ["book"], examples=3).select("book", "glyph", "count", F.array_join("words", " ").alias("words"))


def glyph_units(spark, sf_dir):
    """Units of a glyph, where two glyphs of a word that follow each other are a unit."""
    words = events(spark, sf_dir).select("book", F.regexp_extract_all("glyphs", F.lit("(?s)..?"), F.lit(0)).alias("units"), F.col("event_id").alias("seq"))
    return A.unit_examples(words, ["book"], examples=3).select("book", "glyph", F.array_join("units", " ").alias("units"))


def zero_width_glyphs(spark, sf_dir):
    rows = occurrences(spark, sf_dir).select("book", F.col("shape_id").alias("glyph"), (F.col("bbox.x1") - F.col("bbox.x0") - 30).cast("double").alias("width"))
    return A.zero_width(rows, ["book"])


def atlas(spark, sf_dir):
    """Atlas rows of shapes in use, but for those on the exclusion list (ids without a grid)."""
    excluded = table(spark, sf_dir, "shape_catalog").where("grid is null").select("shape_id").distinct()
    stated = table(spark, sf_dir, "atlas_rows").dropDuplicates(["book", "shape_id"])
    readings = stated.select("book", "shape_id", F.col("proposal").alias("reading"), F.lit(1).alias("seq"))
    same = stated.groupBy("shape_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("same")))).alias("same"))
    rows = A.atlas_rows(occurrences(spark, sf_dir).where("shape_id is not null"), readings, same, maybe_broadcast(excluded), ["book"])
    return rows.select("book", "shape_id", "count", "band", "proposal", "votes", F.size("same").alias("like"))


QUERIES = {
    f.__name__: f
    for f in (
        spatial_best_match, spatial_compare, learning_observations, quality_by_page, confusions, edit_distances, ground_truth, ground_truth_total, output_changes,
        mapping_diff, mapping_verdicts, entry_conflicts, glyph_names, shape_ranking, alphabet_stats, alphabet_growth, systematic_sample, member_sample, majority_reading,
        glyph_statistics, glyph_units, zero_width_glyphs, atlas,
    )
}

_AREA = "(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)))"
_PAIRS = f"""WITH s AS (SELECT wc_id, any_value(book) AS book, any_value(page) AS page, any_value(bbox) AS a, any_value(ocr) AS ocr, any_value(ocr_bbox) AS b FROM word_comparisons GROUP BY 1),
p AS (SELECT l.wc_id, r.wc_id AS ocr_no, r.ocr, {_AREA} AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS t
  FROM (SELECT wc_id, book, page, a FROM s) l JOIN (SELECT wc_id, book, page, ocr, b FROM s WHERE b IS NOT NULL AND ocr IS NOT NULL) r ON l.book = r.book AND l.page = r.page),
o AS (SELECT wc_id, ocr_no, ocr, CASE WHEN t - i > 0 THEN i / (t - i) ELSE 0 END AS overlap FROM p WHERE i > 0),
best AS (SELECT *, row_number() OVER (PARTITION BY wc_id ORDER BY overlap DESC, ocr_no) AS k FROM o)
"""
_OCC = "o AS (SELECT DISTINCT book, page, line, word, position, shape_id, band, bbox FROM occurrences)"


def _converted_sql(letter: str, method: str) -> str:
    """CTEs that end in ``t<letter>`` (event_id, x): every event's text by a method's mapping."""
    made = f"{MAP_SQL.format(method=method)}, tok AS (SELECT event_id, unnest(t) AS t, generate_subscripts(t, 1) AS i FROM (SELECT event_id, regexp_extract_all(glyphs, (SELECT p FROM pat)) AS t FROM ev)), seg AS (SELECT event_id, t, i, u FROM tok LEFT JOIN m ON t = k), raw AS (SELECT event_id, replace({_RAW}, chr(2), '') AS r FROM seg GROUP BY 1), txt AS (SELECT event_id, {complete_sql('r')} AS x FROM raw)"
    for name in ("pat", "tok", "seg", "raw", "txt", "m"):
        made = re.sub(rf"\b{name} AS \(", f"{name}_{letter} AS (", made)
        made = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {name}_{letter}", made)
    return made


_DIFF = f"""{EVENTS_SQL}, {_converted_sql('c', METHODS[1])}, {_converted_sql('r', METHODS[0])},
d AS (SELECT ev.event_id, ev.page, ev.glyphs, ev.ocr_text, c.x AS candidate, r.x AS reference FROM ev JOIN txt_c c USING (event_id) JOIN txt_r r USING (event_id) WHERE c.x <> r.x)"""
_GROUPED = f"""g AS (SELECT glyphs, candidate, reference, count(*) AS count, count(*) FILTER ({comparable_sql('ocr_text')} = {comparable_sql('candidate')}) AS candidate_votes,
  count(*) FILTER ({comparable_sql('ocr_text')} = {comparable_sql('reference')}) AS reference_votes, arg_min(page, page::BIGINT * 1000000000 + event_id) AS first_page FROM d GROUP BY 1, 2, 3),
v AS (SELECT *, CASE WHEN contains(candidate, '⟦') THEN 'candidate_gap' WHEN candidate_votes > 0 AND reference_votes = 0 THEN 'old_wrong' WHEN reference_votes > 0 AND candidate_votes = 0 THEN 'new_wrong' ELSE 'human' END AS verdict FROM g)"""
_COMP = f"{comparable_sql('ocr')} <> {comparable_sql('converted')}"



def distance_sql(a: str, b: str) -> str:
    """Edit distance of two lists of up to 127 distinct values: each becomes one byte."""
    code = lambda x: f"array_to_string(list_transform({x}, lambda w: chr(CAST(list_position(list_distinct(list_concat({a}, {b})), w) AS INT))), '')"
    return f"levenshtein({code(a)}, {code(b)})"


def words_sql(text: str) -> str:
    from lipimala.plans.text_queries import comparable_sql

    return f"list_filter(string_split_regex({comparable_sql(text)}, '[\\s\\p{{Z}}\\x{{85}}]+'), lambda w: w <> '')"


def letters_sql(text: str) -> str:
    return f"list_filter(string_split_regex({text}, ''), lambda w: w <> '')"


_COMPARED = "s AS (SELECT wc_id, any_value(book) AS book, any_value(page) AS page, any_value(converted) AS converted, any_value(ocr) AS ocr, any_value(confidence) AS confidence FROM word_comparisons GROUP BY 1)"
_TRUTH = f"""WITH {_COMPARED}, t AS (SELECT book, page, string_agg(coalesce(CASE WHEN confidence >= 80 THEN coalesce(ocr, converted) ELSE converted END, ''), ' ' ORDER BY wc_id) AS proof,
  string_agg(converted, ' ' ORDER BY wc_id) AS converted, string_agg(coalesce(ocr, ''), ' ' ORDER BY wc_id) AS ocr FROM s WHERE converted IS NOT NULL GROUP BY 1, 2),
w AS (SELECT book, page, {words_sql('proof')} AS r, {words_sql('converted')} AS c, {words_sql('ocr')} AS o FROM t),
l AS (SELECT *, {letters_sql("array_to_string(r, ' ')")} AS rl, {letters_sql("array_to_string(c, ' ')")} AS cl, {letters_sql("array_to_string(o, ' ')")} AS ol FROM w),
e AS (SELECT book, page, CAST(len(r) AS INT) AS reference_words, CAST({distance_sql('r', 'c')} AS INT) AS converted_word_errors, CAST({distance_sql('r', 'o')} AS INT) AS ocr_word_errors,
  {distance_sql('rl', 'cl')} / greatest(1, len(rl)) AS converted_cer, {distance_sql('rl', 'ol')} / greatest(1, len(rl)) AS ocr_cer FROM l)
"""

ORACLE = {
    "ground_truth": _TRUTH + """SELECT book, page, reference_words, converted_word_errors, ocr_word_errors, round(coalesce(converted_word_errors / nullif(reference_words, 0), 0), 6) AS converted_wer,
  round(coalesce(ocr_word_errors / nullif(reference_words, 0), 0), 6) AS ocr_wer, round(converted_cer, 6) AS converted_cer, round(ocr_cer, 6) AS ocr_cer FROM e""",
    "ground_truth_total": _TRUTH + """, x AS (SELECT CAST(sum(reference_words) AS BIGINT) AS reference_words, CAST(sum(converted_word_errors) AS BIGINT) AS converted_word_errors, CAST(sum(ocr_word_errors) AS BIGINT) AS ocr_word_errors FROM e)
SELECT *, round(converted_word_errors / reference_words, 6) AS converted_wer, round(ocr_word_errors / reference_words, 6) AS ocr_wer FROM x""",
    "edit_distances": f"""WITH {_COMPARED}, x AS (SELECT wc_id, {letters_sql('converted')} AS a, {letters_sql('ocr')} AS b, string_split_regex(regexp_replace(converted, '([ -])', '\\1' || chr(1), 'g'), chr(1)) AS c,
  string_split_regex(regexp_replace(ocr, '([ -])', '\\1' || chr(1), 'g'), chr(1)) AS d FROM s WHERE ocr IS NOT NULL AND converted IS NOT NULL)
SELECT wc_id, CAST({distance_sql('a', 'b')} AS INT) AS characters, true AS agrees, CAST({distance_sql("list_filter(c, lambda w: w <> '' OR len(c) = 1)", "list_filter(d, lambda w: w <> '' OR len(d) = 1)")} AS INT) AS words FROM x""",
    "spatial_best_match": _PAIRS + "SELECT wc_id, ocr_no, round(overlap, 6) AS overlap FROM best WHERE k = 1 AND overlap >= 0.3",
    "spatial_compare": _PAIRS + "SELECT book, count(*) AS words, count(m.ocr_no) AS matched FROM s LEFT JOIN (SELECT wc_id, ocr_no FROM best WHERE k = 1 AND overlap >= 0.3) m USING (wc_id) GROUP BY 1",
    "learning_observations": _PAIRS + "SELECT wc_id, ocr AS ocr_text FROM best WHERE k = 1 AND overlap >= 0.5 AND regexp_full_match(ocr, '[ఀ-౿.,;:!?()''\"-]+')",
    "quality_by_page": f"""WITH {WC_SQL}, x AS (SELECT *, ocr IS NOT NULL AND confidence IS NOT NULL AS mt, ocr IS NOT NULL AND confidence IS NOT NULL AND {_COMP} AS df FROM wc),
q AS (SELECT book, coalesce(page, 0) AS page, count(*) AS words, count(*) FILTER (mt) AS matched, count(*) FILTER (df) AS disagreements, count(*) FILTER (contains(converted, '⟦')) AS unresolved,
  coalesce(sum(confidence) FILTER (mt AND NOT df), 0) AS ca, coalesce(sum(confidence) FILTER (df), 0) AS cd FROM x GROUP BY GROUPING SETS ((book, page), (book)))
SELECT book, page, words, matched, disagreements, unresolved, words - matched AS unmatched, matched - disagreements AS agreements,
  round(CASE WHEN matched > 0 THEN (matched - disagreements) / matched ELSE 1 END, 4) AS agreement_rate,
  round(CASE WHEN matched > disagreements THEN ca / (matched - disagreements) ELSE 0 END, 4) AS mean_confidence_agreeing, round(CASE WHEN disagreements > 0 THEN cd / disagreements ELSE 0 END, 4) AS mean_confidence_disagreeing FROM q""",
    "mapping_diff": f"WITH {_DIFF}, " + _GROUPED + " SELECT * FROM v",
    "mapping_verdicts": f"WITH {_DIFF}, " + _GROUPED + """ SELECT n AS verdict, count(v.verdict) AS groups, CAST(coalesce(sum(v."count"), 0) AS BIGINT) AS words
  FROM (SELECT unnest(['new_wrong', 'candidate_gap', 'human', 'old_wrong']) AS n) LEFT JOIN v ON v.verdict = n GROUP BY 1""",
    "entry_conflicts": "SELECT glyphs, count(DISTINCT unicode) AS texts, count(DISTINCT entry_id) AS entries FROM mapping_entries GROUP BY 1 HAVING count(DISTINCT unicode) > 1",
    "glyph_names": """WITH n AS (SELECT glyphs AS g, min(unicode) AS name FROM mapping_entries WHERE length(glyphs) = 1 GROUP BY 1), e AS (SELECT DISTINCT entry_id, glyphs FROM mapping_entries),
c AS (SELECT entry_id, unnest(regexp_extract_all(glyphs, '(?s).')) AS g, generate_subscripts(regexp_extract_all(glyphs, '(?s).'), 1) AS i FROM e)
SELECT entry_id, string_agg(coalesce(name, '?'), ' ' ORDER BY i) AS shapes FROM c LEFT JOIN n USING (g) GROUP BY 1""",
    "shape_ranking": f"WITH {_OCC} SELECT book, shape_id, count(*) AS count, arg_max_null(band, page::BIGINT * 1000000000 + line * 1000000 + word * 1000 + position) AS band FROM o WHERE shape_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2",
    "alphabet_stats": f"""WITH {_OCC}, c AS (SELECT book, shape_id, count(*) AS n FROM o WHERE shape_id IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY book ORDER BY n DESC, shape_id) AS cum, sum(n) OVER (PARTITION BY book) AS total FROM c)
SELECT book, count(*) AS shapes, count(*) FILTER (n = 1) AS singletons, count(*) FILTER (cum < total * 0.99::DOUBLE) + 1 AS shapes_for_coverage, CAST(max(total) AS BIGINT) AS occurrences FROM r GROUP BY 1""",
    "alphabet_growth": f"""WITH {_OCC}, f AS (SELECT book, shape_id, min(page) AS page FROM o WHERE shape_id IS NOT NULL GROUP BY 1, 2)
SELECT p.book, p.page, count(f.shape_id) AS new_shapes FROM (SELECT DISTINCT book, page FROM o) p LEFT JOIN f ON f.book = p.book AND f.page = p.page GROUP BY 1, 2""",
    "systematic_sample": f"""WITH {_OCC}, r AS (SELECT book, shape_id, page, line, word, position, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY book, shape_id) AS n FROM o WHERE shape_id IS NOT NULL
  WINDOW w AS (PARTITION BY book, shape_id ORDER BY page, line, word, position))
SELECT book, shape_id, page, line, word, position FROM r WHERE n <= 5 OR list_contains(list_transform(range(5), lambda k: (k * (n - 1)) // 4), i)""",
    "member_sample": f"WITH {_OCC} SELECT shape_id, least(count(*), 16) AS members FROM o WHERE shape_id IS NOT NULL GROUP BY 1",
    "majority_reading": f"""WITH {EVENTS_SQL}, v AS (SELECT glyphs, ocr_text, count(*) AS votes, min(event_id) AS f FROM ev WHERE ocr_text <> '' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY glyphs ORDER BY votes DESC, f) AS k FROM v)
SELECT e.glyphs, coalesce(r.ocr_text, '') AS proposal, coalesce(r.votes, 0) AS votes FROM (SELECT DISTINCT glyphs FROM ev) e LEFT JOIN r ON r.glyphs = e.glyphs AND k = 1""",
    "glyph_statistics": f"""WITH {EVENTS_SQL}, w AS (SELECT book, glyphs, count(*) AS n, min(event_id) AS f FROM ev WHERE glyphs <> '' GROUP BY 1, 2),
c AS (SELECT book, glyphs, n, f, unnest(regexp_extract_all(glyphs, '(?s).')) AS glyph FROM w), g AS (SELECT book, glyph, glyphs, n, f, count(*) * any_value(n) AS cnt FROM c GROUP BY book, glyph, glyphs, n, f),
r AS (SELECT *, row_number() OVER (PARTITION BY book, glyph ORDER BY n DESC, length(glyphs), f) AS k FROM g)
SELECT book, glyph, CAST(sum(cnt) AS BIGINT) AS count, string_agg(glyphs, ' ' ORDER BY k) FILTER (k <= 3) AS words FROM r GROUP BY 1, 2""",
    "glyph_units": f"""WITH {EVENTS_SQL}, u AS (SELECT book, event_id, unnest(regexp_extract_all(glyphs, '(?s)..?')) AS unit, generate_subscripts(regexp_extract_all(glyphs, '(?s)..?'), 1) AS nth FROM ev),
c AS (SELECT book, unit, count(*) AS n, min(event_id * 100000 + nth) AS f FROM u WHERE length(unit) > 1 GROUP BY 1, 2), d AS (SELECT DISTINCT book, unit, n, f, unnest(regexp_extract_all(unit, '(?s).')) AS glyph FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY book, glyph ORDER BY n DESC, length(unit), f) AS k FROM d) SELECT book, glyph, string_agg(unit, ' ' ORDER BY k) AS units FROM r WHERE k <= 3 GROUP BY 1, 2""",
    "zero_width_glyphs": f"WITH {_OCC} SELECT book, shape_id AS glyph, count(*) AS count, count(*) FILTER (bbox.x1 - bbox.x0 - 30 < 0.5) AS zero, 2 * count(*) FILTER (bbox.x1 - bbox.x0 - 30 < 0.5) > count(*) AS zero_width FROM o GROUP BY 1, 2",
    "atlas": f"""WITH {_OCC}, ex AS (SELECT DISTINCT shape_id FROM shape_catalog WHERE grid IS NULL), c AS (SELECT book, shape_id, count(*) AS count, arg_max_null(band, page::BIGINT * 1000000000 + line * 1000000 + word * 1000 + position) AS band
  FROM o WHERE shape_id IS NOT NULL AND shape_id NOT IN (SELECT shape_id FROM ex) GROUP BY 1, 2),
a AS (SELECT book, shape_id, any_value(proposal) AS proposal FROM atlas_rows GROUP BY 1, 2), sm AS (SELECT DISTINCT book, shape_id, same FROM atlas_rows), k AS (SELECT DISTINCT shape_id FROM atlas_rows),
l AS (SELECT shape_id, len(list_distinct(list(x))) + max(CASE WHEN x IS NULL THEN 1 ELSE 0 END) AS n FROM (SELECT shape_id, unnest(same) AS x FROM sm) GROUP BY 1)
SELECT c.book, c.shape_id, c.count, c.band, coalesce(a.proposal, '') AS proposal, CAST(CASE WHEN a.proposal <> '' THEN 1 ELSE 0 END AS BIGINT) AS votes, CAST(CASE WHEN k.shape_id IS NULL THEN NULL ELSE coalesce(l.n, 0) END AS INT) AS "like"
FROM c LEFT JOIN a ON a.book = c.book AND a.shape_id = c.shape_id LEFT JOIN k ON k.shape_id = c.shape_id LEFT JOIN l ON l.shape_id = c.shape_id""",
}
ORACLE = {k: v for k, v in ORACLE.items() if v}
