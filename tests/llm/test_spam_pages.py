"""Pages that are no texts, and texts that only look like such pages."""

import pytest

from lipimala.llm.spam_pages import label_text, other_share, recurrence, spam_pages

PROSE = "The run of 23 March lost the speck but left the corrector smudged. The faint ledger maps the alphabet near the fold. Nobody printed it twice."
SPAM = {
    "template": "Best scan, online scan reader, scan font. Top scan, cheap scan license, scan poster! Free scan, new scan bundle, scan pack.",
    "list": "akshara pack, akshara font, akshara pack, lipi offer, akshara pack, lipi offer, akshara font, lipi offer, akshara pack, lipi offer",
    "lines": "\n".join(["తోతొ scan", "మంభె font", "తోతొ scan", "తోతొ scan", "మంభె font"] * 6),
    "disguised": "fr33_unic0d3_lit3 free_unicode_lite u\u200bnic0d3r3ad3r4 unicodereader free_unicode_lite best unicode scan3 b3st unic0d3 scan7 ch3ap+unic0d3+lic3ns34 cheap+unicode+license fr33_unic0d3_lit32 best unicode scan",
    "tail": " ".join(f"word{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(5)) + " " + "glyph pack offer " * 15,
    "links": "www.a.example/x\nnew scan\n#pro\nhttps://b.test/y?id=3\nతోతొ మంభె\nc.d.invalid/z\n#font\nhttp://e.example/",
    "anchors": '<a href="https://a.test/x">word</a>\n<a href="b.example/y">font pack</a>\n<a href="www.c.invalid/">scan</a>',
    "tags": "Tags: #one #two #three #four #five #six #seven #eight",
    "counts": "Popular: bar (63), stem (71), ring (183), line (9), fold (12), gap (6)",
    "products": "\n".join(f"fast pack SKU-{i} | {i}.49 | in stock" for i in range(100, 112)),
    "mostly": f"{PROSE}\n" + "glyph pack glyph font glyph offer " * 40,
}
HONEST = {
    "prose": PROSE,
    "short": "The rare stem counts the column near the fold.",
    "word": "సీంకాటణ్లు దుళళా తోతొ మంభె. యాంగేము సీంకాటణ్లు కరటాదూ చాగధదా, శ్శూళిరం ళధిచొటద. సీంకాటణ్లు ముచొదా టోయచొదే లాధొచూమా.",
    "refrain": "\n".join(f"{a} కరటాదూ {b} చాగధదా,\nతోతొ మంభె యాంగేము దుళళా." for a, b in (("ఒకటి", "రెండు"), ("మూడు", "నాలుగు"), ("ఐదు", "ఆరు"))),
    "glossary": "తోతొ: Each ring has its own quiet cluster, which collects the coverage.\nమంభె = A faded summary keeps every stem of the shelf.",
    "table": "glyphs\tunicode\tpage\tnote\nab\tతోతొ\t48\tEach stroke has its own faint table, which orders the folio.\ncd\tమంభె\t157\tThis line is late.",
    "links after": f"{PROSE}\n\n1. The regular index needs the variant at the line end. See http://a.invalid/b\n2. It took a day. See www.c.test/d",
    "legacy": "ÅûSc²z ÙÍ³Ú åhO¼eX=? ƒÅµ'å‹ ¡àf¢ë± Ê∞Î`Ò½'› P¿∂*wÙÍ í=ùÐÿí=ù r¯]#gO³YÏ Í¿&®Hú{Ý åYàäSc.",
}


@pytest.mark.parametrize("name", SPAM)
def test_spam(name):
    assert other_share(SPAM[name]) > 0.5


@pytest.mark.parametrize("name", HONEST)
def test_honest(name):
    assert other_share(HONEST[name]) < 0.5


def test_a_label_between_addresses_belongs_to_the_list():
    assert [s for s, _ in label_text("a.test/x\ntop pack\nb.test/y")] == ["links"] * 3


def test_recurrence():
    assert recurrence([]) == recurrence(["a"]) == 0
    assert recurrence(["a"] * 20) == 1
    assert recurrence(list("abcdefghijklmnop")) == 0


def test_rows(spark):
    rows = [(1, SPAM["list"], "x"), (1, SPAM["list"], "x"), (2, HONEST["prose"], None), (3, None, None), (4, "", None), (5, " \n\t", None), (6, "***", None), (7, "glyph pack glyph font " * 20_000, "y"), (8, "\r\n".join([PROSE] * 300), None)]
    found = spam_pages(spark.createDataFrame(rows, "doc_id bigint, text string, Text_ string"), "doc_id", "text")
    assert sorted(r.doc_id for r in found.collect()) == [1, 7]
    assert spam_pages(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0
