"""Learning a mapping from readings: votes, acceptance, rounds until nothing is accepted.

State is two tables: entries (glyphs, unicode, first_page, first_word) and pending proposals (glyphs, unicode,
count, first_page, first_word, contexts). A round segments the observed words with the entries, lets every
word with one gap and one candidate vote once, and accepts glyphs with one proposal seen in two contexts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipimala.functions.telugu import comparable, is_telugu_word
from lipimala.operators.solver import propose, propose_confirmed
from lipimala.operators.transcode import COMPILED, Mapping, gaps, glyph_count, gap_length, render, segments_by_join, with_segments
from lipimala.runtime import cut, small, uncut

# Contexts a proposal needs, and confidence a reading needs to cast doubt on mapped text.
CONTEXTS, SUSPECT_CONFIDENCE = 2, 60.0

ENTRIES = "glyphs string, unicode string, first_page int, first_word string"
PENDING = "glyphs string, unicode string, count bigint, first_page int, first_word string, contexts array<string>"


@dataclass
class State:
    entries: DataFrame
    pending: DataFrame


def empty_pending(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], PENDING)


def vote(pending: DataFrame, votes: DataFrame) -> DataFrame:
    """Pending proposals with new votes (glyphs, unicode, context, page, word, seq): a vote adds one to the
    count and its context to the set; page and word of the first vote stay."""
    new = votes.groupBy("glyphs", "unicode").agg(F.count("*").alias("count"), F.min_by(F.struct("page", "word"), F.struct("page", "seq")).alias("first"), F.collect_set("context").alias("contexts"))
    shaped = new.select("glyphs", "unicode", "count", F.col("first.page").alias("first_page"), F.col("first.word").alias("first_word"), "contexts", F.lit(1).alias("age"))
    both = pending.withColumn("age", F.lit(0)).unionByName(shaped)
    merged = both.groupBy("glyphs", "unicode").agg(F.sum("count").alias("count"), F.min_by(F.struct("first_page", "first_word"), "age").alias("first"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("contexts")))).alias("contexts"))
    return merged.select("glyphs", "unicode", "count", F.col("first.first_page").alias("first_page"), F.col("first.first_word").alias("first_word"), "contexts")


def accept(state: State, least: int = CONTEXTS) -> tuple[DataFrame, State]:
    """(accepted, new state): glyphs with exactly one proposal in ``least`` contexts or more that have no entry
    yet become entries; their proposals leave. Conflicting proposals wait for a human."""
    alone = state.pending.groupBy("glyphs").agg(F.count("*").alias("n")).where("n = 1").select("glyphs")
    ripe = state.pending.where(F.size("contexts") >= least).join(alone, "glyphs", "left_semi").join(state.entries, "glyphs", "left_anti")
    accepted = cut(ripe.select("glyphs", "unicode", "first_page", "first_word"), "accepted")
    entries = cut(state.entries.unionByName(accepted), "entries")
    pending = cut(state.pending.join(accepted, "glyphs", "left_anti"), "pending")
    return accepted, State(entries, pending)


def segmented(words: DataFrame, glyphs: str, entries: DataFrame, *, limit: int = COMPILED) -> DataFrame:
    """Words with segments by the entries: compiled where they are few enough, joined by their distinct texts
    where not. Both ways give the same; a null text has null segments."""
    if small(entries, limit):
        return with_segments(words, glyphs, Mapping(entries, limit=limit))
    texts = words.select(F.col(glyphs).alias("_spelled"), F.col(glyphs).alias("_text")).where("_text is not null").distinct()
    return words.join(segments_by_join(texts, "_spelled", "_text", entries), F.col(glyphs) == F.col("_spelled"), "left").drop("_spelled")


def observed_words(words: DataFrame, reading: str = "ocr_text") -> DataFrame:
    """Words whose reading is a Telugu word."""
    return words.where(is_telugu_word(F.col(reading)))


def learn_round(observed: DataFrame, state: State, voted: DataFrame) -> tuple[DataFrame, DataFrame, State]:
    """(accepted, voted, state) after one round over observed (seq, page, glyphs, ocr_text)."""
    open_words = observed.join(voted, "seq", "left_anti")
    parts = segmented(open_words, "glyphs", state.entries).where(F.size(gaps(F.col("segments"))) == 1)
    found = parts.select(F.col("seq").alias("key"), "segments", F.col("ocr_text").alias("target")).mapInArrow(propose, "key bigint, glyphs string, unicode string, context string")
    votes = found.withColumnRenamed("key", "seq").join(observed.select("seq", F.col("page"), F.col("ocr_text").alias("word")), "seq")
    votes = cut(votes, "votes")
    pending = cut(vote(state.pending, votes), "pending")
    accepted, state = accept(State(state.entries, pending))
    voted = cut(voted.unionByName(votes.select("seq")), "voted")
    uncut(votes)
    uncut(pending)
    return accepted, voted, state


def learn_until_stable(observed: DataFrame, state: State, *, max_rounds: int = 100) -> tuple[DataFrame, State]:
    """(accepted, state) after rounds until one accepts nothing. A word votes once at most."""
    spark = observed.sparkSession
    voted, learned = spark.createDataFrame([], "seq bigint"), spark.createDataFrame([], ENTRIES)
    given = state
    for _ in range(max_rounds):
        before, voted_before = state, voted
        accepted, voted, state = learn_round(observed, state, voted)
        if before is not given:  # the tables of a round end with the next, those of the caller are left alone
            uncut(before.entries)
            uncut(before.pending)
            uncut(voted_before)
        if not accepted.limit(1).count():
            return learned, state
        learned = learned.unionByName(accepted)
    raise RuntimeError(f"glyphs are still accepted after {max_rounds} rounds")


def learn_pages(observed: DataFrame, state: State, pages: list[int], stop_after: int | None = None) -> tuple[DataFrame, State]:
    """Page by page in order, as what a page teaches changes the next; stops after ``stop_after`` entries.

    The page list is the batch a human will review, so it is short. ``learn_until_stable`` over all words is
    the batch form for large collections: its votes see all pages at once.
    """
    learned, total = observed.sparkSession.createDataFrame([], ENTRIES), 0
    for page in pages:
        accepted, state = learn_until_stable(observed.where(F.col("page") == page), state)
        learned = learned.unionByName(accepted)
        total += accepted.count()
        if stop_after is not None and total >= stop_after:
            break
    return learned, state


def unseen_pages(pages: DataFrame, progress: DataFrame, key: list[str]) -> DataFrame:
    """Pages not in the progress table yet."""
    return pages.join(progress, key, "left_anti")


def page_progress(words: DataFrame, before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(``key``, glyphs, unmapped_before, unmapped_after) of words (ident, glyphs) under two sets of entries."""
    old = segmented(words, "glyphs", before).groupBy(*key).agg(F.sum(glyph_count(F.col("segments"))).alias("glyphs"), F.sum(gap_length(F.col("segments"))).alias("unmapped_before"))
    new = segmented(words, "glyphs", after).groupBy(*key).agg(F.sum(gap_length(F.col("segments"))).alias("unmapped_after"))
    return old.join(new, key)


def classify(words: DataFrame, entries: DataFrame, confidence: str = "confidence", reading: str = "ocr_text", least: float = SUSPECT_CONFIDENCE) -> DataFrame:
    """Words with text and status: ``unresolved`` with a gap, ``suspect`` where a confident reading is another
    text, else null."""
    shown = segmented(words, "glyphs", entries)
    gap = F.size(gaps(F.col("segments"))) > 0
    text = render(F.col("segments"))
    doubt = (comparable(text) != comparable(F.col(reading))) & (F.col(confidence) >= least)
    return shown.withColumn("text", text).withColumn("status", F.when(gap, "unresolved").when(doubt, "suspect")).drop("segments")


def grouped_occurrences(classified: DataFrame, examples: int = 4) -> DataFrame:
    """(status, text, words, readings): rows of a report, with the first distinct readings."""
    return classified.where("status is not null").groupBy("status", "text").agg(F.count("*").alias("words"), F.slice(F.array_sort(F.collect_set("ocr_text")), 1, examples).alias("readings"))


def apply_suspicions(entries: DataFrame, suspicions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, changes): accepted suggestions (glyphs, suggested, status and, where known, page and word) that are
    not empty replace texts or become entries; of several for one key the last in ``ordinal``, or else the greatest,
    holds. changes lists (glyphs, before, after) of entries that differ now, before being empty for new ones."""
    there = suspicions.columns
    last = F.col("ordinal") if "ordinal" in there else F.col("suggested")
    page = (F.col("page") if "page" in there else F.lit(None)).cast("int").alias("page")
    word = (F.col("word") if "word" in there else F.lit("")).alias("word")
    wanted = suspicions.where("status = 'accepted' and suggested <> ''").groupBy("glyphs").agg(F.max_by(F.struct("suggested", page, word), last).alias("new"))
    joined = entries.join(wanted, "glyphs", "full")
    differs = F.col("new").isNotNull() & ~F.col("unicode").eqNullSafe(F.col("new.suggested"))
    changes = joined.where(differs).select("glyphs", F.coalesce("unicode", F.lit("")).alias("before"), F.col("new.suggested").alias("after"))
    put = {"unicode": "suggested", "first_page": "page", "first_word": "word"}
    done = joined.select("glyphs", *((F.when(differs, F.col(f"new.{put[c]}")).otherwise(F.col(c)) if c in put else F.col(c)).alias(c) for c in entries.columns if c != "glyphs"))
    return done.select(*entries.columns), changes


def words_with_key(words: DataFrame, entries: DataFrame, keys: DataFrame) -> DataFrame:
    """Words of which some segment is one of ``keys`` (glyphs)."""
    parts = segmented(words, "glyphs", entries).select("seq", F.explode(F.transform("segments", lambda s: s["glyphs"])).alias("key"))
    hit = parts.join(keys.select(F.col("glyphs").alias("key")).distinct(), "key", "left_semi").select("seq").distinct()
    return words.join(hit, "seq", "left_semi")


def confirm(confirmations: DataFrame, words: DataFrame, state: State, reviewed: DataFrame | None = None, *, passes: int = 3) -> tuple[DataFrame, State]:
    """(results, state) of confirmations (shown, correct) against words (seq, page, glyphs).

    A word that already gives the correct text settles a confirmation. Else the first word shown as stated
    under the reviewed entries whose gaps the correct text solves adds its solution, unless an entry says
    otherwise. Solutions open others, so unsolved ones are tried again, ``passes`` times at most. Results:
    shown, correct, status, page, solution, overrides. A word is a candidate only if it holds the glyphs of all
    gaps shown; candidates are found by equality of their text, of which they are then a part.
    """
    asked = cut(confirmations.select("shown", "correct").distinct(), "asked")
    reviewed = state.entries if reviewed is None or not reviewed.limit(1).count() else reviewed
    under_review = segmented(words, "glyphs", reviewed).select("seq", "page", "glyphs", comparable(render(F.col("segments"))).alias("match"))
    has_gap = F.contains(F.col("shown"), F.lit("⟦"))
    holds = F.forall(F.regexp_extract_all("shown", F.lit("⟦(.*?)⟧"), F.lit(1)), lambda gap: F.contains(F.col("glyphs"), gap))
    matched = cut(asked.withColumn("match", comparable(F.col("shown"))).join(under_review, "match").where(holds).groupBy("shown", "correct", "glyphs").agg(F.min(F.struct("page", "seq")).alias("at")), "matched")
    done = None
    for _ in range(passes):
        now = segmented(words, "glyphs", state.entries).select("page", "seq", "glyphs", comparable(render(F.col("segments"))).alias("match"))
        right = asked.withColumn("match", comparable(F.col("correct"))).join(now, "match").where(holds).groupBy("shown", "correct").agg(F.min(F.struct("page", "seq")).alias("right"))
        tried = segmented(matched.withColumn("seq", F.xxhash64("shown", "correct", "glyphs")), "glyphs", state.entries)
        solved = tried.where(has_gap).select(F.struct("shown", "correct", "at").alias("key"), "segments", F.col("correct").alias("target"))
        kind = solved.schema["key"].dataType.simpleString()
        answers = solved.mapInArrow(propose_confirmed, f"key {kind}, solution map<string,string>, overrides string")
        first = answers.groupBy(F.col("key.shown").alias("shown"), F.col("key.correct").alias("correct")).agg(F.min_by(F.struct(F.col("key.at.page").alias("page"), "solution", "overrides"), F.col("key.at")).alias("hit"))
        pairs = first.select("shown", "correct", F.explode(F.map_entries("hit.solution")).alias("e")).select("shown", "correct", "e.key", "e.value")
        against = pairs.join(state.entries.select(F.col("glyphs").alias("key"), "unicode"), "key").where("unicode <> value").groupBy("shown", "correct").agg(F.array_join(F.array_sort(F.collect_set("key")), " ").alias("conflict"))
        seen = matched.groupBy("shown", "correct").agg(F.min("at").alias("seen"))
        joined = asked.join(right, ["shown", "correct"], "left").join(seen, ["shown", "correct"], "left").join(first, ["shown", "correct"], "left").join(against, ["shown", "correct"], "left")
        status = (
            F.when(F.col("right").isNotNull(), "already correct")
            .when(~has_gap, F.when(F.col("seen").isNotNull(), "correction of mapped text: needs review").otherwise("not found"))
            .when(F.col("conflict").isNotNull(), F.concat(F.lit("conflicts with existing "), "conflict"))
            .when(F.col("hit").isNotNull(), "added")
            .when(F.col("seen").isNotNull(), "unsolved")
            .otherwise("not found")
        )
        page = F.when(F.col("right").isNotNull(), F.col("right.page")).when(F.col("hit").isNotNull(), F.col("hit.page")).when(~has_gap, F.col("seen.page"))
        results = cut(joined.withColumn("status", status).select("shown", "correct", "status", page.alias("page"), F.when(F.col("status") == "added", F.col("hit.solution")).alias("solution"), F.when(F.col("status") == "added", F.col("hit.overrides")).alias("overrides")), "confirmed")
        new = results.where("status = 'added'").select("page", "correct", F.explode(F.map_entries("solution")).alias("e")).groupBy(F.col("e.key").alias("glyphs")).agg(F.min_by(F.struct(F.col("e.value").alias("unicode"), F.col("page").alias("first_page"), F.col("correct").alias("first_word")), F.struct("page", "correct")).alias("x")).select("glyphs", "x.*")
        new = cut(new.join(state.entries, "glyphs", "left_anti"), "new")
        fresh = results.where(~F.col("status").isin("unsolved", "not found"))
        done = fresh if done is None else cut(done.unionByName(fresh), "done")
        if not fresh.limit(1).count():
            rest = results
            break
        rest = results.where(F.col("status").isin("unsolved", "not found"))
        asked = cut(rest.select("shown", "correct"), "asked")
        matched = cut(matched.join(asked, ["shown", "correct"], "left_semi"), "matched")
        state = State(cut(state.entries.unionByName(new), "entries"), cut(state.pending.join(new, "glyphs", "left_anti"), "pending"))
    return (rest if done is None else done.unionByName(rest.where(F.col("status").isin("unsolved", "not found")))), state
