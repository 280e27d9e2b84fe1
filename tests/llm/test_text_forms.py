"""Consistent forms of look-alike texts."""

import unicodedata

import pytest

from lipimala.llm.lookalike import consistent_forms, fold, repair_candidate, same_look


@pytest.mark.parametrize("a, b, same", [
    ("క్ష", "క్‌ష", False),  # a visible virama prints differently
    ("క్‌‌ష", "క్‌ష", True),
    ("క్‌", "క్", True),
    ("త​ోతొ", "తోతొ", True),
    ("ＡＢＣ１２－３", "ABC12-3", True),
    (unicodedata.normalize("NFD", "Śśūḷiraṃ"), "Śśūḷiraṃ", True),
    ("\xa0కరటా　దూ ", "కరటా దూ", True),
    ("x¹", "x1", False),
    ("కై", "కై", True),
    ("ﬁ", "fi", True),
    ("క", "ఖ", False),
    ("", "​", True),
])
def test_fold(a, b, same):
    assert (fold(a) == fold(b)) is same


@pytest.mark.parametrize("word, want", [("ಲాభము", "లాభము"), ("cāṭilеṃ", "cāṭileṃ"), ("తోతొ", None), ("ಲಿ", None), ("абв", None), ("", None), ("абвo", "абво"), ("сор", "cop"), ("каzzz", None), ("Ρpuji", "Ppuji"), ("ಲాలಲೋ", None), ("niyɑvūda", "niyavūda"), ("క‌аb", None)])
def test_repair_candidate(word, want):
    assert repair_candidate(word) == want


def test_repair_needs_a_known_word(spark):
    texts = [(1, "ಲాభము!"), (2, "ಜడము"), (3, "జడము"), (4, "ಯదుಲ"), (5, "యదుಲ"), (6, "ಒకటి"), (7, None), (8, " "), (9, "ಲాభము " * 2000)]
    lexicon = spark.createDataFrame([("లాభము", "y")], "word string, WORD string")
    got = {r.k: r.form for r in consistent_forms(spark.createDataFrame(texts, "k int, t string"), ["k"], "t", lexicon).collect()}
    assert got[1] == "లాభము!" and got[2] == got[3] == "జడము"
    assert (got[4], got[5], got[6]) == ("ಯదుಲ", "యదుಲ", "ಒకటి")  # nothing attests the repair
    assert got[7] is None and got[8] == "" and got[9] == " ".join(["లాభము"] * 2000)


def test_same_look(spark):
    wc = [(1, "తోతొ", "తో​తొ"), (1, "తోతొ", "తో​తొ"), (2, "తోతొ", "తోతొ"), (3, "తోతొ", None), (4, "తోతొ", ""), (5, "తోతొ", "తోతె"), (6, "తోతొ", "తోతొ "), (7, None, None)]
    entries = [(1, "g", "క"), (2, "g", "క​"), (3, "g", "ఖ"), (4, "h", "క​"), (5, None, "క"), (6, None, "క​"), (7, "i", None)]
    got = same_look(spark.createDataFrame(wc, "wc_id bigint, converted string, ocr string"), spark.createDataFrame(entries, "entry_id bigint, glyphs string, unicode string"), spark.createDataFrame([], "word string"))
    assert {tuple(r) for r in got.collect()} == {("word_comparisons", 1), ("word_comparisons", 6), ("mapping_entries", 1), ("mapping_entries", 2)}
