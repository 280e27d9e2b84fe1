"""One consistent form for texts that look the same in print and differ in their characters.

First every text is folded: full-width forms and print ligatures become plain letters, accents are composed,
all blanks are one blank, and characters that leave no ink go, except the joiner that makes a virama visible.
Then look-alike letters are repaired by script: the dominant script of a word is that of most of its letters
among those that can write it whole, and in a word of mixed scripts the letters of others are replaced by their
doubles in it, where the corpus or the lexicon knows the resulting word.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lipimala.runtime import cut, maybe_broadcast, pick, uncut

# Letters of other scripts and the letters they print like.
TELUGU_DOUBLES = dict(zip("ಂಃಅಆಇಒಓಔಜಣಯಱಲ೦೧೨೯", "ంఃఅఆఇఒఓఔజణయఱల౦౧౨౯", strict=True))
LATIN_DOUBLES = dict(
    zip(
        "ɑɡɩаеорсухіјѕԁһӏԛԝвмАВЕКМНОРСТХІЈЅοραιυνκςϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ",
        "aɡiaeopcyxijsdhlqwвмABEKMHOPCTXIJSopaiuvkςcjABEZHIKMNOPTYXC",
        strict=True,
    )
)
for _same in "ɡвмς":  # these print like no plain letter
    LATIN_DOUBLES.pop(_same)
LATIN_DOUBLES |= {"ɡ": "g"}
# Viramas of the scripts that have one.
VIRAMAS = "्্੍્୍்్್്"

_BLANK = regex.compile(r"[\p{Zs}\p{Zl}\p{Zp}\t\n\v\f\r\x85]+")
_NO_INK = r"[\p{Cf}͏︀-️᠋-᠏]"
_VISIBLE = regex.compile(rf"([{VIRAMAS}])({_NO_INK}+)(?=\p{{Lo}})")
_INVISIBLE = regex.compile(rf"(?![‌]){_NO_INK}|(?<![{VIRAMAS}])‌|‌(?!\p{{Lo}})")
_PIECE = regex.compile(r"[\p{L}\p{M}‌]+|[^\p{L}\p{M}‌]+")
_PLAIN = regex.compile(r"[!-~ఀ-ౕౘ-౿]+(?: [!-~ఀ-ౕౘ-౿]+)*")
_SCRIPT = regex.compile(r"(\p{Telugu})|(\p{Latin})|(\p{Kannada})|(\p{Cyrillic})|(\p{Greek})")
SCRIPTS = ("Telugu", "Latin", "Kannada", "Cyrillic", "Greek")


@lru_cache(1)
def _print_forms() -> dict[int, str]:
    """Wide and narrow forms, Latin print ligatures and numerals, hyphens: same print, other code."""
    forms = {}
    for c in (*range(0xFF00, 0xFFF0), *range(0xFB00, 0xFB07), *range(0x2160, 0x2180)):
        plain = unicodedata.normalize("NFKC", chr(c))
        if plain != chr(c):
            forms[c] = plain
    return forms | {0x2010: "-", 0x2011: "-", 0xB5: "μ"}


def fold(text: str) -> str:
    """Everything but look-alike letters."""
    if _PLAIN.fullmatch(text):
        return text
    text = unicodedata.normalize("NFC", text.translate(_print_forms()))
    text = _VISIBLE.sub(lambda m: m[1] + ("‌" if "‌" in m[2] or "​" in m[2] else ""), text)
    text = _INVISIBLE.sub("", text)
    return unicodedata.normalize("NFC", _BLANK.sub(" ", text).strip())


@lru_cache(1)
def _doubles() -> dict[str, dict[str, str]]:
    """For every script the letters of others that print like one of its own."""
    into: dict[str, dict[str, str]] = {script: {} for script in SCRIPTS}
    for table in (TELUGU_DOUBLES, LATIN_DOUBLES):
        for foreign, own in table.items():
            into[_script(own)][foreign] = own
            if _script(foreign) != _script(own):
                into[_script(foreign)].setdefault(own, foreign)
    return into


def _script(letter: str) -> str | None:
    m = _SCRIPT.match(letter)
    return SCRIPTS[m.lastindex - 1] if m else None


def repair_candidate(word: str) -> str | None:
    """The word in its dominant script, null where nothing is to repair or no substitution makes it of one script.

    Of the scripts that have a double for every letter of another script in the word, the one of most letters is
    dominant, and between equals the earlier one of ``SCRIPTS``.
    A word made of look-alikes of one other script only holds no letter that tells its script; it is read as
    Telugu or Latin.
    """
    count = Counter(x for c in word if (x := _script(c)) is not None)
    if not count:
        return None
    into = _doubles()
    made = {x: "".join(c if _script(c) in (None, x) and not (x == "Latin" and c in LATIN_DOUBLES) else into[x].get(c, c) for c in word) for x in count}
    whole = {x: all(_script(c) in (None, x) for c in m) for x, m in made.items()}
    script = max(count, key=lambda x: (whole[x], count[x], -SCRIPTS.index(x)))
    if not whole[script]:
        return None
    if len(count) == 1 and made[script] == word:
        for x in ("Telugu", "Latin"):
            if x != script and all(c in into[x] for c in word if _script(c)):
                return unicodedata.normalize("NFC", "".join(into[x].get(c, c) for c in word))
    return unicodedata.normalize("NFC", made[script]) if made[script] != word else None


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the folded text's pieces, words and what is between, and the words to repair."""

    @lru_cache(1 << 17)
    def of(text: str) -> tuple[list, list]:
        pieces = _PIECE.findall(fold(text))
        repairs = {p: r for p in pieces if not p.isascii() and (r := repair_candidate(p)) is not None and r != p}
        return pieces, list(repairs.items())

    kinds = pa.list_(pa.string()), pa.map_(pa.string(), pa.string())
    for batch in batches:
        both = [of(t) if t is not None else (None, None) for t in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in both], kinds[0]), pa.array([x for _, x in both], kinds[1])], names=[*batch.schema.names, "pieces", "repairs"])


def consistent_forms(texts: DataFrame, key: list[str], text: str, lexicon: DataFrame | None = None, *, label: str = "forms") -> DataFrame:
    """``key`` columns, ``text`` and its ``form``: equal forms look the same in print.

    A null text has a null form, an empty or blank one the empty form. A look-alike word is repaired when
    the result is a word of ``lexicon`` (column word) or of ``texts``.
    """
    rows = pick(texts, *key, text)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    folded = cut(rows.mapInArrow(_pieces, f"{ddl}, pieces array<string>, repairs map<string,string>"), label)
    wanted = folded.where(F.size("repairs") > 0).select(F.explode("repairs").alias("word", "repaired")).distinct()
    wanted = cut(wanted, f"{label}-wanted")
    targets = wanted.select("repaired").distinct()
    known = folded.select(F.explode("pieces").alias("repaired"))
    if lexicon is not None:
        known = known.unionByName(pick(lexicon, "word").select(F.col("word").alias("repaired")))
    known = known.join(maybe_broadcast(targets), "repaired", "left_semi").distinct()
    fixes = cut(wanted.join(known, "repaired", "left_semi"), f"{label}-fixes")
    uncut(wanted)
    plain = folded.where(F.coalesce(F.size("repairs"), F.lit(0)) <= 0).select(*key, text, F.array_join("pieces", "").alias("form"))
    # only texts with a word to repair meet the fixes; what becomes of a text depends on nothing else
    mixed = folded.where(F.size("repairs") > 0)
    words = mixed.select(text, F.explode(F.map_keys("repairs")).alias("word")).distinct().join(maybe_broadcast(fixes), "word")
    own = words.groupBy(text).agg(F.map_from_entries(F.collect_list(F.struct("word", "repaired"))).alias("fix"))
    fixed = mixed.join(own, text, "left").select(*key, text, F.array_join(_replaced(F.col("pieces"), F.col("fix")), "").alias("form"))
    return plain.unionByName(fixed)


def _replaced(pieces: Column, fix: Column) -> Column:
    return F.when(fix.isNull(), pieces).otherwise(F.transform(pieces, lambda p: F.coalesce(F.element_at(fix, p), p)))


def same_look(comparisons: DataFrame, mapping: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(src, row_id): comparisons whose two texts, and entries whose text and that of another entry with
    the same glyphs, differ in characters and look the same. Null and empty texts are no case."""
    wc = pick(comparisons, "wc_id", "converted", "ocr").dropDuplicates(["wc_id"])
    entries = pick(mapping, "entry_id", "glyphs", "unicode").dropDuplicates(["entry_id"])
    sides = [("converted", wc.select(F.lit("word_comparisons").alias("src"), F.col("wc_id").alias("row_id"), F.lit(None).cast("string").alias("glyphs"), F.explode(F.array("converted", "ocr")).alias("text")))]
    sides.append(("unicode", entries.select(F.lit("mapping_entries").alias("src"), F.col("entry_id").alias("row_id"), "glyphs", F.col("unicode").alias("text"))))
    texts = sides[0][1].unionByName(sides[1][1]).where("text <> ''")
    forms = consistent_forms(texts, ["src", "row_id", "glyphs"], "text", lexicon)
    pairs = forms.where("src = 'word_comparisons'").groupBy("src", "row_id").agg(F.count("*").alias("n"), F.min("text").alias("a"), F.max("text").alias("b"), F.min("form").alias("fa"), F.max("form").alias("fb"))
    found = pairs.where("n = 2 and a <> b and fa = fb").select("src", "row_id")
    entry = forms.where("src = 'mapping_entries' and glyphs is not null")
    several = entry.groupBy("glyphs", "form").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("glyphs", "form")
    return found.unionByName(entry.join(several, ["glyphs", "form"], "left_semi").select("src", "row_id"))
