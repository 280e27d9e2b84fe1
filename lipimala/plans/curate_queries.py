"""Queries of learning, recipes, page layout, shapes, probes, sources and streams, with SQL where it can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lipimala.functions.glyphs import characters
from lipimala.operators import learn as L
from lipimala.operators import probe as P
from lipimala.operators import recipes as R
from lipimala.operators import scan_layout as SL
from lipimala.operators import shape_index as SI
from lipimala.plans.measure_queries import WC_SQL, comparisons
from lipimala.plans.text_queries import EVENTS_SQL, METHODS, _RAW, _SEGMENTS, comparable_sql, complete_sql, events, occurrences
from lipimala.runtime import once, shared_dir, table
from lipimala.sources import outputs, pages, tsv
from lipimala.streaming import ingest

# --- learning ----------------------------------------------------------------------------------------


def _entries(spark, sf_dir, method=METHODS[1]):
    rows = table(spark, sf_dir, "mapping_entries").where(F.col("method") == method).dropDuplicates(["entry_id"])
    return rows.select("glyphs", F.coalesce("unicode", F.lit("")).alias("unicode"), "first_page", "first_word")


def _observed(spark, sf_dir):
    rows = events(spark, sf_dir).where("glyphs is not null").select(F.col("event_id").alias("seq"), F.col("page_number").alias("page"), "glyphs", "ocr_text")
    return L.observed_words(rows)


def learn_accepted(spark, sf_dir):
    """Entries learned from all readings, round after round."""
    state = L.State(_entries(spark, sf_dir), L.empty_pending(spark))
    return L.learn_until_stable(_observed(spark, sf_dir), state)[0]


def learn_pending(spark, sf_dir):
    state = L.State(_entries(spark, sf_dir), L.empty_pending(spark))
    pending = L.learn_round(_observed(spark, sf_dir), state, spark.createDataFrame([], "seq bigint"))[2].pending
    return pending.select("glyphs", "unicode", "count", "first_page", F.size("contexts").alias("contexts"))


def vote_accept(spark, sf_dir):
    """Votes of the readings for their whole glyph words; books are the contexts."""
    votes = events(spark, sf_dir).where("glyphs <> '' and ocr_text <> ''").select("glyphs", F.col("ocr_text").alias("unicode"), F.col("book").alias("context"), F.col("page_number").alias("page"), F.col("ocr_text").alias("word"), F.col("event_id").alias("seq"))
    pending = L.vote(L.empty_pending(spark), votes)
    accepted, _ = L.accept(L.State(_entries(spark, sf_dir), pending))
    return accepted.select("glyphs", "unicode", "first_page")


def word_status(spark, sf_dir):
    rows = events(spark, sf_dir).where("glyphs is not null").select(F.col("event_id").alias("seq"), "glyphs", "ocr_text", (40.0 + F.col("event_id") % 50).alias("confidence"))
    return L.classify(rows, _entries(spark, sf_dir, METHODS[0])).select("seq", "status")


def word_groups(spark, sf_dir):
    rows = events(spark, sf_dir).where("glyphs is not null").select(F.col("event_id").alias("seq"), "glyphs", "ocr_text", (40.0 + F.col("event_id") % 50).alias("confidence"))
    return L.grouped_occurrences(L.classify(rows, _entries(spark, sf_dir))).select("status", "text", "words")


def page_progress(spark, sf_dir):
    rows = events(spark, sf_dir).where("glyphs is not null").select(F.col("event_id").alias("seq"), "book", F.col("page_number").alias("page"), "glyphs")
    return L.page_progress(rows, _entries(spark, sf_dir), _entries(spark, sf_dir, METHODS[0]), ["book", "page"])


def unseen_pages(spark, sf_dir):
    read = table(spark, sf_dir, "ocr_words").select("book", "page").distinct()
    return L.unseen_pages(table(spark, sf_dir, "scan_pages").select("book", "page").distinct(), read, ["book", "page"])


def suspicion_changes(spark, sf_dir):
    other = _entries(spark, sf_dir).select("glyphs", F.col("unicode").alias("suggested"), F.lit("accepted").alias("status"))
    return L.apply_suspicions(_entries(spark, sf_dir, METHODS[0]), other)[1]


def words_with_key(spark, sf_dir):
    keys = _entries(spark, sf_dir, METHODS[2]).select("glyphs")
    rows = events(spark, sf_dir).where("glyphs is not null").select(F.col("event_id").alias("seq"), "glyphs")
    return L.words_with_key(rows, _entries(spark, sf_dir, METHODS[0]), keys).select("seq")


def confirmations(spark, sf_dir):
    """The readings of unresolved words as a reviewer would confirm them."""
    entries = _entries(spark, sf_dir)
    rows = events(spark, sf_dir).where("glyphs is not null").select(F.col("event_id").alias("seq"), F.col("page_number").alias("page"), "glyphs", "ocr_text")
    shown = L.classify(rows.withColumn("confidence", F.lit(0.0)), entries).where("status = 'unresolved' and ocr_text <> ''")
    asked = shown.groupBy(F.col("text").alias("shown")).agg(F.min("ocr_text").alias("correct"))
    return L.confirm(asked, rows.drop("ocr_text"), L.State(entries, L.empty_pending(spark)))[0].select("shown", "correct", "status", "page")


# --- recipes -----------------------------------------------------------------------------------------


def _recipe_tables(spark, sf_dir):
    """Single glyphs named by their text, and recipes for the sequences of named glyphs."""
    single = _entries(spark, sf_dir, METHODS[0]).where("length(glyphs) = 1 and unicode <> ''")
    names = single.select(F.col("glyphs").alias("glyph"), F.col("unicode").alias("name"), "unicode")
    known = _entries(spark, sf_dir, METHODS[0]).where("length(glyphs) > 1").select(F.col("glyphs").alias("recipe"), "unicode", F.length("glyphs").alias("n"), F.posexplode(characters(F.col("glyphs"))).alias("pos", "glyph"))
    named = known.join(names.select("glyph", "name"), "glyph").groupBy("recipe", "unicode", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))
    return names, named.where(F.size("names") == F.col("n")).select("recipe", "names", "unicode")


def recipe_expand(spark, sf_dir):
    return R.expand(*_recipe_tables(spark, sf_dir))


#: Names and recipes that break every rule once, and recipes that others make needless.
_BAD_NAMES = [("§1", "twice", "క"), ("§1", "again", "ఖ"), ("§2", "several", "గ"), ("§3", "several", "ఘ"), *((f"¶{i}", "many", "చ") for i in range(9))]
_BAD_RECIPES = [("r1", ["twice"], "ట"), ("r2", ["twice", "nobody"], "ఠ"), ("r3", ["many", "many"], "డ"), ("r4", ["twice", "again"], "త"), ("r5", ["twice", "again"], "థ")]
_NEEDLESS = [("n1", ["one", "two"], "పబ"), ("n2", ["three", "four"], "మ")]


def recipe_violations(spark, sf_dir):
    """What forbids compiling the mapping's names and recipes together with some that break the rules."""
    names, recipes = _recipe_tables(spark, sf_dir)
    names = names.unionByName(spark.createDataFrame(_BAD_NAMES, "glyph string, name string, unicode string"))
    return R.violations(names, recipes.unionByName(spark.createDataFrame(_BAD_RECIPES, "recipe string, names array<string>, unicode string")))


def recipe_redundant(spark, sf_dir):
    """Recipes of the mapping, and of two more, that the other entries make needless: the first of the two is."""
    names, recipes = _recipe_tables(spark, sf_dir)
    names = names.unionByName(spark.createDataFrame([("\ue001", "one", "ప"), ("\ue002", "two", "బ"), ("\ue003", "three", "గ"), ("\ue004", "four", "జ")], "glyph string, name string, unicode string"))
    return R.redundant(names, recipes.unionByName(spark.createDataFrame(_NEEDLESS, "recipe string, names array<string>, unicode string")))


# --- page layout -------------------------------------------------------------------------------------


def _parts(spark, sf_dir):
    key = F.col("line") * 1_000_000 + F.col("word") * 1000 + F.col("position")
    return occurrences(spark, sf_dir).select("book", "page", key.alias("part"), "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")


def body_heights(spark, sf_dir):
    return SL.body_heights(_parts(spark, sf_dir), ["book", "page"])


def text_area(spark, sf_dir):
    kept = SL.text_area(_parts(spark, sf_dir).withColumn("page_height", F.lit(800)), ["book", "page"])
    return kept.groupBy("book", "page").agg(F.count("*").alias("parts"))


def page_layout(spark, sf_dir):
    parts = _parts(spark, sf_dir).join(body_heights(spark, sf_dir), ["book", "page"])
    found = SL.layout(parts, ["book", "page"], "part")
    return found.groupBy("book", "page").agg(F.count("*").alias("parts"), F.max("line").alias("lines"), F.count_if(F.col("position") == 1).alias("words"))


# --- shapes ------------------------------------------------------------------------------------------


def _shapes(spark, sf_dir):
    return table(spark, sf_dir, "shape_catalog").dropDuplicates(["shape_id"])


def gated_neighbours(spark, sf_dir):
    shapes = _shapes(spark, sf_dir)
    return SI.gated_neighbours(shapes, shapes).select("shape_id", "other", F.round("stray", 6).alias("stray"), "rank")


def shape_matches(spark, sf_dir):
    shapes = _shapes(spark, sf_dir)
    return SI.best_match(SI.thick_tested(SI.gated_neighbours(shapes, shapes), shapes, shapes))


def _near(spark, sf_dir, shapes=None):
    shapes = _shapes(spark, sf_dir) if shapes is None else shapes
    return SI.gated_neighbours(shapes, shapes, k=SI.WIDE, distance=SI.WIDE_STRAY, limit=SI.THICK_BLOB)


def _checked(spark, sf_dir, near):
    """Shapes with their occurrences n, which all have the shape's verdict; a shape's own canvas is like itself."""
    own = _shapes(spark, sf_dir).where("grid is not null and canvas is not null").select("shape_id", F.col("shape_id").alias("other"))
    matches = near.where("alike").select("shape_id", "other").unionByName(own).groupBy("shape_id").agg(F.collect_list("other").alias("matches"))
    return SI.checks(_counted(spark, sf_dir), matches)


def _counted(spark, sf_dir):
    return occurrences(spark, sf_dir).where("shape_id is not null").groupBy("shape_id").agg(F.count("*").alias("n"))


def verdict_census(spark, sf_dir):
    return SI.verdict_census(_checked(spark, sf_dir, _near(spark, sf_dir)), "n")


def rival_pairs(spark, sf_dir):
    near = _near(spark, sf_dir, once(table(spark, sf_dir, "shape_catalog"), "shape_id"))
    return SI.shared_rivals(near, _counted(spark, sf_dir))


def flagged_shapes(spark, sf_dir):
    return SI.flagged(_checked(spark, sf_dir, _near(spark, sf_dir)), "n")


def same_shapes(spark, sf_dir):
    """Like shapes of every shape, whose own canvas is the one crop; ids on the exclusion list are suggested to none."""
    shapes = _shapes(spark, sf_dir)
    return SI.same_shapes(shapes, shapes, shapes.where("holes is null or shape_id % 50 = 0")).select("shape_id", F.array_join("same", " ").alias("same"))


def leader_clusters(spark, sf_dir):
    return SI.lead_clusters(_shapes(spark, sf_dir).select("shape_id", "band", "holes", "grid", "canvas", "height", "aspect"), ["shape_id"], "shape_id")


def keep_assignments(spark, sf_dir):
    """Earlier ids of components, where the ink is still the same; late rows are indexed anew."""
    now = table(spark, sf_dir, "occurrences").repartition("book", "page").dropDuplicates(["book", "page", "line", "word", "position"])
    before = now.where("shape_id is not null").withColumn("ink", F.when(F.col("word") % 2 == 0, F.col("ink")).otherwise(F.col("ink") + 1))
    kept = SI.keep_assignments(now, before, ["book", "page"], table(spark, sf_dir, "shape_catalog"))
    return kept.groupBy("book").agg(F.count("*").alias("parts"), F.count("kept").alias("kept"))


def page_ranking(spark, sf_dir):
    return SI.rank_pages(occurrences(spark, sf_dir), ["book"]).withColumn("covered", F.round("covered", 6))


# --- probes ------------------------------------------------------------------------------------------


def height_percentile(spark, sf_dir):
    rows = _parts(spark, sf_dir).select("book", (F.col("y1") - F.col("y0")).cast("double").alias("h"))
    return P.font_measure(P.percentile(rows, ["book"], "h", 0.9))


def ink_extents(spark, sf_dir):
    return P.ink_extents(_shapes(spark, sf_dir), "shape_id")


def glyph_assignment(spark, sf_dir):
    """Shapes of a book with even ids laid on those with odd ids by their bitmaps, as two fonts of one layout would be."""
    used = table(spark, sf_dir, "atlas_rows").where("book is not null").select("book", "shape_id").distinct()
    grids = _shapes(spark, sf_dir).where("length(grid) = 288").select("shape_id", "grid")
    rows = used.join(grids, "shape_id").select(F.col("book").alias("font"), "shape_id", "grid")
    even, odd = (rows.where(F.col("shape_id") % 2 == k).withColumnRenamed("shape_id", name) for k, name in ((0, "glyph"), (1, "target")))
    found = P.assign_glyphs(P.likeness(even, odd))
    return found.select("font", "glyph", "target", F.round("score", 6).alias("score"), "status")


# --- sources and streams -----------------------------------------------------------------------------


def tsv_round_trip(spark, sf_dir):
    """The mapping written as a table for people and read back: quotes and empty texts survive."""
    path = f"{shared_dir(spark)}/mapping-{uuid.uuid4().hex}.tsv"
    rows = _entries(spark, sf_dir, METHODS[0])
    tsv.save_entries(rows, path)
    return tsv.load_entries(spark, path)


def ocr_cache(spark, sf_dir):
    wanted = table(spark, sf_dir, "scan_pages").select("book", "page").distinct()
    return pages.missing_pages(wanted, table(spark, sf_dir, "ocr_words"), ["book", "page"]).groupBy("book").agg(F.count("*").alias("missing"))


def ocr_clean(spark, sf_dir):
    rows = table(spark, sf_dir, "ocr_words").dropDuplicates(["book", "page", "ocr_no"])
    return pages.ocr_words(rows, 2.0).select("book", "page", "ocr_no", "text", "bbox.x0", "bbox.y1")


def run_manifest(spark, sf_dir):
    rows = table(spark, sf_dir, "scan_pages").groupBy("book", "page").agg(F.first("glyphs").alias("glyphs"), F.first("unmapped").alias("unmapped"), F.max("converted_at").alias("converted_at"))
    gone = F.aggregate(F.map_values(F.coalesce("unmapped", F.create_map().cast("map<string,bigint>"))), F.lit(0).cast("bigint"), lambda n, v: n + F.coalesce(v, F.lit(0)))
    return rows.groupBy("book").agg(F.count("*").alias("pages"), F.sum("glyphs").alias("glyphs"), F.sum(gone).alias("unmapped"), outputs.stamp_of(F.max("converted_at")).alias("created"))


def stream_shape_counts(spark, sf_dir):
    """Shape counts per day from a stream that is read to its end."""
    source = table(spark, sf_dir, "occurrences")
    name = f"shapes_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(source.schema).parquet(_stream_dir(sf_dir, "occurrences"))
    counts = ingest.first_deliveries(stream, within="3650 days").where("shape_id is not null").groupBy("book", "shape_id").agg(F.count("*").alias("n"))
    path = f"{shared_dir(spark)}/{name}"
    ingest.resumable(counts, lambda frame, _: frame.write.mode("overwrite").parquet(path), f"{path}-state").outputMode("complete").start().awaitTermination()
    return spark.read.parquet(path)


def _stream_dir(sf_dir, name):
    from pathlib import Path

    path = Path(f"{sf_dir}/{name}.parquet".removeprefix("file:"))
    return str(path if path.is_dir() else path.parent / f"{name}.parque[t]")


QUERIES = {
    f.__name__: f
    for f in (
        learn_accepted, learn_pending, vote_accept, word_status, word_groups, page_progress, unseen_pages, suspicion_changes, words_with_key, confirmations,
        recipe_expand, recipe_violations, recipe_redundant, body_heights, text_area, page_layout, gated_neighbours, shape_matches, verdict_census, rival_pairs, flagged_shapes,
        same_shapes, leader_clusters, keep_assignments, page_ranking, height_percentile, ink_extents, glyph_assignment, tsv_round_trip, ocr_cache, ocr_clean, run_manifest, stream_shape_counts,
    )
}

_M = lambda name, method: f"{name} AS (SELECT DISTINCT entry_id, glyphs, coalesce(unicode, '') AS unicode, first_page, first_word FROM mapping_entries WHERE method = '{method}')"
_PARTS = "p AS (SELECT DISTINCT book, page, line, word, position, bbox.x0 AS x0, bbox.y0 AS y0, bbox.x1 AS x1, bbox.y1 AS y1 FROM occurrences)"
_FULL = _SEGMENTS.replace(f"'{METHODS[1]}'", f"'{METHODS[0]}'")

ORACLE = {
    "vote_accept": f"""WITH {EVENTS_SQL}, {_M('e', METHODS[1])}, v AS (SELECT glyphs, ocr_text AS unicode, count(DISTINCT book) AS contexts, arg_min(page, page::BIGINT * 1000000000 + event_id) AS first_page FROM ev WHERE glyphs <> '' AND ocr_text <> '' GROUP BY 1, 2),
n AS (SELECT *, count(*) OVER (PARTITION BY glyphs) AS k FROM v) SELECT glyphs, unicode, first_page FROM n WHERE k = 1 AND contexts >= 2 AND glyphs NOT IN (SELECT glyphs FROM e)""",
    "word_status": _FULL + f""", r AS (SELECT event_id, replace({_RAW}, chr(2), '') AS r, bool_or(u IS NULL) AS gap FROM seg GROUP BY 1)
SELECT ev.event_id AS seq, CASE WHEN r.gap THEN 'unresolved' WHEN {comparable_sql(complete_sql("coalesce(r.r, '')"))} <> {comparable_sql('ev.ocr_text')} AND 40 + event_id % 50 >= 60 THEN 'suspect' END AS status FROM ev LEFT JOIN r USING (event_id) WHERE ev.glyphs IS NOT NULL""",
    "word_groups": _SEGMENTS + f""", r AS (SELECT event_id, replace({_RAW}, chr(2), '') AS r, bool_or(u IS NULL) AS gap FROM seg GROUP BY 1),
s AS (SELECT {complete_sql("coalesce(r.r, '')")} AS text, r.gap, ev.ocr_text, event_id FROM ev LEFT JOIN r USING (event_id) WHERE ev.glyphs IS NOT NULL),
t AS (SELECT text, CASE WHEN gap THEN 'unresolved' WHEN {comparable_sql('text')} <> {comparable_sql('ocr_text')} AND 40 + event_id % 50 >= 60 THEN 'suspect' END AS status FROM s) SELECT status, text, count(*) AS words FROM t WHERE status IS NOT NULL GROUP BY 1, 2""",
    "page_progress": _SEGMENTS + f""", a AS (SELECT ev.book, ev.page, coalesce(sum(CASE WHEN t <> ' ' THEN length(t) END), 0) AS glyphs, coalesce(sum(CASE WHEN u IS NULL THEN length(t) END), 0) AS unmapped_before FROM ev LEFT JOIN seg USING (event_id) WHERE ev.glyphs IS NOT NULL GROUP BY 1, 2),
m2 AS (SELECT glyphs AS k, max(coalesce(unicode, '')) AS u FROM mapping_entries WHERE method = '{METHODS[0]}' AND glyphs NOT IN ('', ' ') GROUP BY 1 UNION ALL SELECT ' ', ' '),
pat2 AS (SELECT '(?s)' || string_agg(regexp_escape(k), '|' ORDER BY length(k) DESC, k) || '|.' AS p FROM m2),
tok2 AS (SELECT book, page, unnest(regexp_extract_all(glyphs, (SELECT p FROM pat2))) AS t FROM ev), b AS (SELECT book, page, coalesce(sum(CASE WHEN u IS NULL THEN length(t) END), 0) AS unmapped_after FROM tok2 LEFT JOIN m2 ON t = k GROUP BY 1, 2)
SELECT a.book, a.page, CAST(glyphs AS BIGINT) AS glyphs, CAST(unmapped_before AS BIGINT) AS unmapped_before, CAST(coalesce(unmapped_after, 0) AS BIGINT) AS unmapped_after FROM a LEFT JOIN b ON a.book = b.book AND a.page = b.page""",
    "unseen_pages": "SELECT DISTINCT book, page FROM scan_pages p WHERE NOT EXISTS (SELECT 1 FROM ocr_words o WHERE o.book = p.book AND o.page = p.page)",
    "suspicion_changes": f"WITH {_M('a', METHODS[0])}, {_M('b', METHODS[1])} SELECT b.glyphs, coalesce(a.unicode, '') AS before, b.unicode AS after FROM (SELECT glyphs, max(unicode) AS unicode FROM b WHERE unicode <> '' GROUP BY 1) b LEFT JOIN a ON a.glyphs = b.glyphs WHERE a.unicode IS NULL OR a.unicode <> b.unicode",
    "words_with_key": _FULL + f" SELECT DISTINCT event_id AS seq FROM seg WHERE t IN (SELECT glyphs FROM mapping_entries WHERE method = '{METHODS[2]}')",
    "recipe_expand": f"""WITH RECURSIVE {_M('e', METHODS[0])}, n AS (SELECT glyphs AS g, unicode AS name FROM e WHERE length(glyphs) = 1 AND unicode <> ''), k AS (SELECT name, count(*) AS k FROM n GROUP BY 1),
c AS (SELECT glyphs, unicode, unnest(range(1, length(glyphs) + 1)) AS i FROM e WHERE length(glyphs) > 1), d AS (SELECT c.glyphs, c.unicode, i, n.name, k FROM c JOIN n ON n.g = c.glyphs[i] JOIN k USING (name)),
r AS (SELECT glyphs, unicode FROM d GROUP BY 1, 2 HAVING count(*) = length(glyphs) AND product(k) <= 64),
x AS (SELECT glyphs, unicode, 0 AS i, '' AS s FROM r UNION ALL SELECT x.glyphs, x.unicode, x.i + 1, x.s || n.g FROM x JOIN d ON d.glyphs = x.glyphs AND d.i = x.i + 1 JOIN n ON n.name = d.name)
SELECT glyphs AS recipe, s AS glyphs, unicode FROM x WHERE i = length(glyphs)""",
    "recipe_violations": f"""WITH {_M('e', METHODS[0])}, n(glyph, name, unicode) AS (SELECT DISTINCT glyphs, unicode, unicode FROM e WHERE length(glyphs) = 1 AND unicode <> ''
  UNION ALL SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}', '{c}')" for a, b, c in _BAD_NAMES)})), k AS (SELECT name, count(*) AS k FROM n GROUP BY 1),
r(recipe, names, unicode) AS (VALUES {', '.join(f"('{a}', {b}, '{c}')" for a, b, c in _BAD_RECIPES)}),
s AS (SELECT recipe, array_to_string(names, ' ') AS what, len(names) AS n, unnest(names) AS name FROM r), g AS (SELECT recipe, what, n, count(k) AS known, product(coalesce(k, 1)) AS size FROM s LEFT JOIN k USING (name) GROUP BY 1, 2, 3),
x AS (SELECT glyph AS key, unicode FROM n UNION SELECT a.glyph || b.glyph, r.unicode FROM r JOIN g USING (recipe) JOIN n a ON a.name = names[1] JOIN n b ON b.name = names[2] WHERE n = 2 AND known = 2 AND size <= 64)
SELECT 'glyph listed twice' AS kind, glyph AS what FROM n GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'name with several texts', name FROM n GROUP BY 2 HAVING count(DISTINCT unicode) > 1
UNION ALL SELECT 'recipe of one name', what FROM g WHERE n < 2 UNION ALL SELECT 'recipe of unknown names', what FROM g WHERE known < n
UNION ALL SELECT 'recipe of too many variants', what FROM g WHERE known = n AND size > 64 UNION ALL SELECT 'key with two texts', key FROM x GROUP BY 2 HAVING count(*) > 1""",
    "body_heights": f"WITH {_PARTS} SELECT book, page, median(y1 - y0) AS body FROM p GROUP BY 1, 2",
    "text_area": f"""WITH {_PARTS}, b AS (SELECT book, page, median(y1 - y0) AS body FROM p GROUP BY 1, 2), q AS (SELECT p.*, x1 - x0 > 8.0 * body AS rule FROM p JOIN b USING (book, page)),
w AS (SELECT *, coalesce(max(y1) FILTER (rule AND y0 < 0.15 * 800) OVER k, 0) AS t, coalesce(min(y0) FILTER (rule AND y1 > 0.85 * 800) OVER k, 800) AS l FROM q WINDOW k AS (PARTITION BY book, page))
SELECT book, page, count(*) AS parts FROM w WHERE NOT rule AND (y0 + y1) / 2 BETWEEN t AND l GROUP BY 1, 2""",
    "keep_assignments": """WITH o AS (SELECT book, page, line, word, position, any_value(shape_id) AS shape_id, any_value(bbox) AS bbox, any_value(ink) AS ink FROM occurrences GROUP BY 1, 2, 3, 4, 5)
SELECT book, count(*) AS parts, count(*) FILTER (shape_id IN (SELECT shape_id FROM shape_catalog) AND word % 2 = 0) AS kept FROM o GROUP BY 1""",
    "gated_neighbours": """WITH s AS (SELECT DISTINCT shape_id, CAST(grid AS BIT) AS g, height, aspect, band, holes FROM shape_catalog WHERE octet_length(grid) = 288),
m AS (SELECT CAST(repeat('0' || repeat('1', 47), 48) AS BIT) AS notfirst, CAST(repeat(repeat('1', 47) || '0', 48) AS BIT) AS notlast),
b AS (SELECT s.*, bit_count(g) AS ink, g | (g << 48) | (g >> 48) | ((g << 1) & notlast) | ((g >> 1) & notfirst) AS w FROM s, m WHERE bit_count(g) > 0),
p AS (SELECT a.shape_id, b.shape_id AS other, (bit_count(a.g & ~b.w) + bit_count(b.g & ~a.w)) / (a.ink + b.ink) AS stray FROM b a JOIN b ON a.band = b.band AND a.holes = b.holes
  AND a.shape_id <> b.shape_id AND abs(ln(a.height / b.height)) <= 0.1 AND abs(ln(a.aspect / b.aspect)) <= 0.1),
r AS (SELECT shape_id, other, stray, row_number() OVER (PARTITION BY shape_id ORDER BY stray, other) AS rank FROM p WHERE stray <= 0.1)
SELECT shape_id, other, round(stray, 6) AS stray, CAST(rank AS INT) AS rank FROM r WHERE rank <= 8""",
    "ink_extents": """WITH s AS (SELECT DISTINCT shape_id, CAST(CAST(grid AS BIT) AS VARCHAR) AS g FROM shape_catalog WHERE octet_length(grid) = 288),
p AS (SELECT shape_id, unnest(range(2304)) AS i, g FROM s), k AS (SELECT shape_id, i // 48 AS y, i % 48 AS x FROM p WHERE substr(g, i + 1, 1) = '1')
SELECT shape_id, min(y) / 48 AS top, (max(y) + 1) / 48 AS bottom, min(x) / 48 AS "left", (max(x) + 1) / 48 AS "right" FROM k GROUP BY 1""",
    "page_ranking": """WITH RECURSIVE o AS (SELECT DISTINCT book, page, line, word, position, shape_id FROM occurrences WHERE shape_id IS NOT NULL),
u AS (SELECT book, page, list(DISTINCT shape_id) AS s FROM o GROUP BY 1, 2), n AS (SELECT book, shape_id, count(*) AS n, sum(count(*)) OVER (PARTITION BY book) AS total FROM o GROUP BY 1, 2),
r AS (SELECT book, 0 AS rank, CAST([] AS BIGINT[]) AS fresh, CAST([] AS BIGINT[]) AS seen, CAST([] AS INT[]) AS done, CAST(NULL AS INT) AS page, CAST(0 AS BIGINT) AS shapes FROM (SELECT DISTINCT book FROM u) UNION ALL
  SELECT book, rank + 1, f, list_concat(seen, f), list_append(done, page), page, len(s) FROM (
    SELECT r.book, r.rank, r.seen, r.done, u.page, u.s, list_filter(u.s, lambda x: NOT list_contains(r.seen, x)) AS f FROM r JOIN u ON u.book = r.book WHERE NOT list_contains(r.done, u.page))
  QUALIFY row_number() OVER (PARTITION BY book ORDER BY len(f) DESC, page) = 1),
c AS (SELECT book, rank, sum(n.n / n.total) AS share FROM (SELECT book, rank, unnest(fresh) AS shape_id FROM r) JOIN n USING (book, shape_id) GROUP BY 1, 2)
SELECT r.book, r.page, r.rank, CAST(r.shapes AS INT) AS shapes, CAST(len(r.fresh) AS INT) AS new_shapes, round(sum(coalesce(c.share, 0)) OVER (PARTITION BY r.book ORDER BY r.rank), 6) AS covered
FROM r LEFT JOIN c USING (book, rank) WHERE rank > 0""",
    "height_percentile": f"""WITH {_PARTS}, r AS (SELECT book, CAST(y1 - y0 AS DOUBLE) AS h, row_number() OVER (PARTITION BY book ORDER BY y1 - y0) - 1 AS i, count(*) OVER (PARTITION BY book) AS n FROM p)
SELECT book, min(h) AS percentile, round(min(h) + 0.05, 2) AS measure FROM r WHERE i = least(n - 1, CAST(floor(0.9::DOUBLE * n) AS BIGINT)) GROUP BY 1""",
    "tsv_round_trip": f"WITH {_M('e', METHODS[0])} SELECT glyphs, unicode, first_page, coalesce(first_word, '') AS first_word FROM e",
    "ocr_cache": "SELECT book, count(*) AS missing FROM (SELECT DISTINCT book, page FROM scan_pages EXCEPT SELECT book, page FROM ocr_words) GROUP BY 1",
    "ocr_clean": "SELECT DISTINCT book, page, ocr_no, trim(text) AS text, bbox.x0 / 2.0::DOUBLE AS x0, bbox.y1 / 2.0::DOUBLE AS y1 FROM ocr_words WHERE trim(text) <> ''",
    "run_manifest": """WITH s AS (SELECT book, page, any_value(glyphs) AS glyphs, any_value(unmapped) AS unmapped, max(converted_at) AS c FROM scan_pages GROUP BY 1, 2)
SELECT book, count(*) AS pages, CAST(sum(glyphs) AS BIGINT) AS glyphs, CAST(sum(coalesce(list_sum(map_values(unmapped)), 0)) AS BIGINT) AS unmapped, strftime(max(c), '%Y%m%dT%H%M%SZ') AS created FROM s GROUP BY 1""",
    "stream_shape_counts": "SELECT book, shape_id, count(*) AS n FROM (SELECT DISTINCT book, page, line, word, position, shape_id FROM occurrences WHERE shape_id IS NOT NULL) GROUP BY 1, 2",
}
