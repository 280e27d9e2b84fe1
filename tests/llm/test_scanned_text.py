"""Scanned text: lines, cut and misread words, paragraphs."""

import pytest

from lipimala.llm.line_model import codes_of, distance, fit, is_title, parted, title_keys
from lipimala.llm.scanned_text import Words, judge_reading, ocr_lines, readable_paragraphs, scan_noise

LEXICON = ["కరటాదూ", "యాంగేము", "తోతొ", "సీంకాటణ్లు", "మంభె", "చాగధదా", "దుళళా", "శ్శూళిరం"]
PAGE = "book string, page int, lines array<string>, converted_at string, PAGE string"
OCR = "book string, page int, ocr_no bigint, text string, bbox struct<x0 double,y0 double,x1 double,y1 double>"
EVENT = "event_id bigint, book string, page_number int, converted string, ocr_text string"


@pytest.fixture(scope="module")
def words():
    return Words(LEXICON)


@pytest.mark.parametrize("token, bad", [("తోతొ,", False), ("తోతొమంభె", False), ("తోతొ-మంభె!", False), ("౧౩౭", False), ("3-4", False), ("⟦#42⟧", False), ("—", False), ("తో1తొ", True), ("4O", True), ("తోత", True), ("", False)])
def test_misread(words, token, bad):
    assert words.misread(token) is bad


@pytest.mark.parametrize("a, b, want", [
    ("కర-", "టాదూ,", (True, False, False)),
    ("కర\xad", "టాదూ", (True, False, False)),
    ("కర", "టాదూ", (True, False, False)),
    ("తోతొ-", "మంభె", (False, False, False)),  # a compound at its own hyphen
    ("తోతొ,", "మంభె", (False, False, False)),
    ("తోతొ", "మంభె", (False, False, False)),
    ("కర-", "ట1ాదూ", (True, False, True)),
    ("క1ర-", "టాదూ", (True, True, False)),
    ("తోతొ-", "మం1భె", (False, False, True)),
    ("కర¬", None, (True, False, False)),
    ("తోతొ-", None, (False, False, False)),
    ("—", "తోతొ", (False, False, False)),
])
def test_across_lines(words, a, b, want):
    assert words.across(a, b) == want


@pytest.mark.parametrize("reading, converted, want", [
    ("కర=", "కరటాదూ", (True, False)),
    ("కర‐", "కర⟦x⟧దూ", (True, False)),
    ("ఖర-", "కరటాదూ", (True, True)),
    ("కరటాదూ!", "కరటాదూ", (False, False)),
    ("కరటాద", "కరటాదూ", (False, True)),
    ("తోతొ-", "తోతొ-మంభె", (False, False)),
    ("", "కరటాదూ", (False, False)),
])
def test_single_readings(words, reading, converted, want):
    assert judge_reading(reading, converted, words) == want


def label_lines(lines, page, titles, model=None):
    return (model or fit([])).label(codes_of(lines, page, titles))


def test_labels():
    titles = ["తోతొ మంభె దుళళా"]
    lines = ["— 4O —", "తోతొ మంభె దు1ళళా — చాగధదా", "", "కరటాదూ యాంగేము,", "881 తోతొ", "40 | చాగధదా"]
    assert label_lines(lines, 40, titles) == ["header", "header", "break", "body", "body", "footer"]
    assert label_lines(["తోతొ", "మంభె."], 7, []) == ["body", "body"]
    assert label_lines([None, "  ", ""], 7, titles) == ["break"] * 3 and label_lines([], None, []) == []


@pytest.mark.parametrize("line, page, want", [
    ("తోతొ మంభె  47", 47, (2, ["తోతొ", "మంభె"])),
    ("పుట ౪౭  తోతొ", 47, (2, ["పుట", "తోతొ"])),
    ("( 17 )", 17, (2, [])),
    ("lo9", 109, (2, [])),
    ("|||", 111, (2, [])),
    ("4| | తోతొ", 41, (2, ["తోతొ"])),
    ("తోతొ  3S", 35, (2, ["తోతొ"])),
    ("4x | తోతొ", 47, (1, ["తోతొ"])),
    ("626 తోతొ మంభె", 41, (0, ["626", "తోతొ", "మంభె"])),
    ("12", 47, (1, [])),
    ("12", None, (1, [])),
    ("", 3, (0, [])),
])
def test_a_line_and_its_number(line, page, want):
    assert parted(line, page) == want


def test_titles():
    assert title_keys("౭౬ | తోతొ మంభె — దుళళా", 76) == ["తోతొ మంభె దుళళా", "తోతొ మంభె"]
    assert title_keys("తోతొ, మంభె", 1) == title_keys("తోతొ మం-", 1) == title_keys(" ", 1) == []
    assert is_title(["తోతొ మం1భె"], ["తోతొ మంభె"]) and not is_title(["తోతొ"], ["తోతొ మంభె"]) and not is_title(["తోతొ"], [])
    assert [distance(*x, 3) for x in (("kitten", "sitting"), ("", "ab"), ("abc", "abc"), ("abcdef", "uvwxyz"))] == [3, 2, 0, 4]


def test_the_model_learns_where_furniture_stands():
    titles, body = ["తోతొ మంభె"], ["కరటాదూ, యాంగేము", "దుళళా! చాగధదా."]
    pages = [([str(p), "తోతొ మంభె", "", f"{p} | తోతొ మంభె", *body * 3], p) for p in range(10, 60)]
    model = fit([codes_of(lines, p, titles) for lines, p in pages])
    assert label_lines(["7", "తోతొ మం1భె", "", "7 | తోతొ మంభె", *body], 7, titles, model) == ["header", "header", "break", "header", "body", "body"]
    assert label_lines([*body, *body], 7, titles, model) == ["body"] * 4


def test_ocr_lines_by_position():
    w = lambda no, y: {"ocr_no": no, "text": "x", "y0": y, "y1": y + 10.0}
    assert [[x["ocr_no"] for x in line] for line in ocr_lines([w(1, 10.0), w(2, 11.0), w(3, 29.0), w(4, 28.0)])] == [[1, 2], [3, 4]]


def _pages():
    body = ["తోతొ మంభె యాంగేము", "దుళళా చాగధదా కర-"]
    rest = ["టాదూ తో1తొ,", "", "మంభె దుళళా"]
    return [("b", 1, ["౧ | శ్శూళిరం తోతొ", *body], "t", "x"), ("b", 2, ["౨ | శ్శూళిరం తోతొ", *rest], "t", "x"), ("b", 2, ["౨ | శ్శూళిరం తోతొ", *rest], "u", "x"), ("b", 3, None, None, None), ("b", 4, [], None, None), ("b", 5, ["౫ | శ్శూళిరం తోతొ", " " * 3, "తోతొ " * 3000], None, None)]


def test_noise(spark):
    ocr = [("b", 1, 1, "తోతొ", (0.0, 0.0, 9.0, 9.0)), ("b", 1, 3, "కర-", (0.0, 20.0, 9.0, 29.0)), ("b", 1, 2, None, (9.0, 0.0, 19.0, 9.0)), ("b", 1, 4, "౧", (0.0, 60.0, 9.0, 69.0)), ("b", 1, 4, "౧", (0.0, 60.0, 9.0, 69.0)), ("z", 9, 1, "తోత1ొ", None)]
    events = [(1, "b", 1, "కరటాదూ", "కర="), (1, "b", 1, "కరటాదూ", "కర="), (2, "b", 1, "తోతొ", None), (3, None, None, None, "తోతx")]
    lexicon = spark.createDataFrame([(w,) for w in [*LEXICON, None, ""]], "word string")
    found = scan_noise(spark.createDataFrame(_pages(), PAGE), spark.createDataFrame(ocr, OCR), spark.createDataFrame(events, EVENT), lexicon).collect()
    assert len(found) == len(set(found))
    assert {tuple(r) for r in found} == {
        *(("scan_pages", "b", p, 1, "furniture") for p in (1, 2, 5)),
        ("scan_pages", "b", 1, 3, "broken"), ("scan_pages", "b", 2, 2, "misread"),
        ("ocr_words", "b", 1, 3, "broken"), ("ocr_words", "b", 1, 4, "furniture"), ("ocr_words", "z", 9, 1, "misread"),
        ("learn_events", "b", 1, 1, "broken"), ("learn_events", None, None, 3, "misread"),
    }


def test_nothing_in_nothing_out(spark):
    empty = [spark.createDataFrame([], s) for s in (PAGE, OCR, EVENT, "word string")]
    assert scan_noise(*empty).count() == 0
    assert readable_paragraphs(empty[0], empty[3]).count() == 0


def test_paragraphs(spark):
    lexicon = spark.createDataFrame([(w,) for w in LEXICON], "word string")
    got = {(r.page, r.paragraph): r.text for r in readable_paragraphs(spark.createDataFrame(_pages()[:4], PAGE), lexicon).collect()}
    assert got == {(1, 1): "తోతొ మంభె యాంగేము దుళళా చాగధదా కరటాదూ", (2, 1): "తోతొ,", (2, 2): "మంభె దుళళా"}


def test_paragraphs_of_ocr_pages_and_over_pages(spark):
    box = lambda k: (0.0, 20.0 * k, 9.0, 20.0 * k + 9)
    ocr = [("b", 1, 1, "తోతొ", box(0)), ("b", 1, 2, None, box(0)), ("b", 1, 3, "కర-", box(1)), ("b", 1, 3, "కర-", box(1)), ("b", 2, 1, "టాదూ", box(0)), ("b", 2, 2, "మంభె॥", box(0)), ("b", 2, 3, "దుళళా", box(1)), ("b", 4, 1, "గేము", box(0))]
    pages = [("b", p, lines, "t", "x") for p, lines in ((1, ["తోతొ మంభె", "కర-"]), (2, ["టాదూ దుళళా"]), (3, ["దుళళా మంభె", "యాం-"]), (4, ["గేము మంభె", ""]), (5, ["చాగధదా"]))]
    lexicon = spark.createDataFrame([(w,) for w in LEXICON], "word string")
    got = readable_paragraphs(spark.createDataFrame(pages, PAGE), lexicon, spark.createDataFrame(ocr, OCR)).collect()
    assert {tuple(r) for r in got} == {
        ("scan_pages", "b", 1, 1, "తోతొ మంభె కరటాదూ", 1, 1), ("scan_pages", "b", 2, 1, "దుళళా", 1, 1), ("scan_pages", "b", 3, 1, "దుళళా మంభె యాంగేము", 1, 1),
        ("scan_pages", "b", 4, 1, "మంభె", 1, 1), ("scan_pages", "b", 5, 1, "చాగధదా", 5, 1),
        ("ocr_words", "b", 1, 1, "తోతొ … కరటాదూ", 1, 1), ("ocr_words", "b", 2, 1, "మంభె॥", 1, 1), ("ocr_words", "b", 2, 2, "దుళళా", 2, 2), ("ocr_words", "b", 4, 1, "యాంగేము", 4, 1),
    }
