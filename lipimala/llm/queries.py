"""Queries of this package by name, and SQL for those that SQL can express."""

from __future__ import annotations

from lipimala.llm.byte_bpe import encode_texts
from lipimala.llm.components import same_shape_groups
from lipimala.llm.lookalike import same_look
from lipimala.llm.packing import container_fill, pack_documents
from lipimala.llm.scanned_text import readable_paragraphs, scan_noise
from lipimala.llm.shape_clusters import cluster_descriptions, cluster_members
from lipimala.llm.spam_pages import spam_pages
from lipimala.llm.term_frequency import corpus_terms, useless_terms
from lipimala.runtime import once, pick, table


def p1_found(spark, sf_dir):
    return useless_terms(*(table(spark, sf_dir, t) for t in ("occurrences", "scan_pages", "glyph_stats")))


def p1_terms(spark, sf_dir):
    return corpus_terms(*(table(spark, sf_dir, t) for t in ("occurrences", "scan_pages", "glyph_stats")))


def p3_found(spark, sf_dir):
    return cluster_members(table(spark, sf_dir, "shape_catalog"))


def p3_clusters(spark, sf_dir):
    return cluster_descriptions(table(spark, sf_dir, "shape_catalog"))


def p4_found(spark, sf_dir):
    return same_look(*(table(spark, sf_dir, t) for t in ("word_comparisons", "mapping_entries", "lexicon")))


def p5_found(spark, sf_dir):
    return scan_noise(*(table(spark, sf_dir, t) for t in ("scan_pages", "ocr_words", "learn_events", "lexicon")))


def p5_paragraphs(spark, sf_dir):
    return readable_paragraphs(*(table(spark, sf_dir, t) for t in ("scan_pages", "lexicon", "ocr_words")))


def p6_found(spark, sf_dir):
    return same_shape_groups(table(spark, sf_dir, "atlas_rows"), table(spark, sf_dir, "shape_catalog"))


def p7_ids(spark, sf_dir):
    return encode_texts(once(pick(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id"), "doc_id", "text")


def p8_containers(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))


def p8_fill(spark, sf_dir):
    return container_fill(pack_documents(table(spark, sf_dir, "documents")))


def p9_found(spark, sf_dir):
    return spam_pages(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p1_found": p1_found, "p1_terms": p1_terms, "p3_found": p3_found, "p3_clusters": p3_clusters, "p4_found": p4_found, "p5_found": p5_found, "p5_paragraphs": p5_paragraphs, "p6_found": p6_found, "p7_ids": p7_ids, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_found": p9_found}

_TERMS = """WITH o AS (SELECT DISTINCT book, page, line, word, position, shape_id FROM occurrences),
g AS (SELECT DISTINCT book, glyph, "count" AS n FROM glyph_stats),
s AS (SELECT book, page, any_value(unmapped) AS unmapped FROM scan_pages GROUP BY ALL),
u AS (SELECT book, page, unnest(map_entries(unmapped)) AS e FROM s),
f AS (
  SELECT 'shape_id' AS field, CAST(shape_id AS VARCHAR) AS term, count(*) AS frequency, count(DISTINCT (book, page)) AS records,
    (SELECT count(*) FROM (SELECT DISTINCT book, page FROM occurrences)) AS total FROM o WHERE shape_id IS NOT NULL GROUP BY 2
  UNION ALL
  SELECT 'unmapped', translate(e.key, '⟦⟧', ''), coalesce(sum(e.value), 0), count(DISTINCT (book, page)),
    (SELECT count(*) FROM (SELECT DISTINCT book, page FROM scan_pages)) FROM u GROUP BY 2
  UNION ALL
  SELECT 'glyph', glyph, coalesce(sum(n), 0), count(DISTINCT book) FILTER (n <> 0),
    (SELECT count(DISTINCT book) FROM glyph_stats) FROM g WHERE glyph IS NOT NULL GROUP BY 2 HAVING count(*) FILTER (n <> 0) > 0),
m AS (SELECT field, term, CAST(frequency AS BIGINT) AS frequency, CAST(records AS BIGINT) AS records,
  CASE WHEN frequency < 5 OR records <= 1 THEN 'rare' WHEN records > total * 0.5 THEN 'common' END AS mark FROM f)
"""

# All pairs, in the sizes at which SQL can compare all pairs, and their connected components: what the clusters must be
# where prints of one form are as near and those of different forms as far as in these tables.
_FORMS = """WITH RECURSIVE s AS (SELECT DISTINCT shape_id, CAST(grid AS BIT) AS g, ln(height) AS h, ln(aspect) AS a, coalesce(band, '?') AS band FROM shape_catalog WHERE octet_length(grid) = 288),
m AS (SELECT CAST(repeat('0' || repeat('1', 47), 48) AS BIT) AS notfirst, CAST(repeat(repeat('1', 47) || '0', 48) AS BIT) AS notlast),
v AS (SELECT s.*, bit_count(g) AS ink, g | (g << 48) | (g >> 48) AS v FROM s WHERE bit_count(g) > 0),
b AS (SELECT v.*, v | ((v << 1) & notlast) | ((v >> 1) & notfirst) AS w FROM v, m),
e AS (SELECT x.shape_id AS a, y.shape_id AS b FROM b x JOIN b y ON x.band = y.band AND x.shape_id <> y.shape_id AND abs(x.h - y.h) <= 0.08 AND abs(x.a - y.a) <= 0.15
  WHERE (bit_count(x.g & ~y.w) + bit_count(y.g & ~x.w)) / (x.ink + y.ink) <= 0.06),
r AS (SELECT a AS shape_id, a AS cluster_id FROM e UNION SELECT e.b, r.cluster_id FROM r JOIN e ON e.a = r.shape_id WHERE r.cluster_id < e.b)
SELECT shape_id, min(cluster_id) AS cluster_id FROM r GROUP BY 1"""

ORACLE = {
    "p3_found": _FORMS,
    "p1_found": _TERMS + "SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
    "p1_terms": _TERMS + "SELECT * FROM m",
    "p6_found": """WITH RECURSIVE links AS (
  SELECT DISTINCT shape_id AS a, s AS b FROM (SELECT shape_id, unnest(same) AS s FROM atlas_rows)
  WHERE shape_id <> s AND shape_id IN (SELECT shape_id FROM shape_catalog) AND s IN (SELECT shape_id FROM shape_catalog)),
e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
r AS (SELECT a AS shape_id, a AS group_id FROM e UNION SELECT e.b, r.group_id FROM r JOIN e ON e.a = r.shape_id WHERE r.group_id < e.b)
SELECT shape_id, min(group_id) AS group_id FROM r GROUP BY 1""",
}
