"""Noise in text from scanned pages: running headers, page numbers, cut words, misread characters.

Lines are labelled by the hidden Markov model of ``line_model``, fitted to a bounded sample of the pages at
hand. Words of body lines are then judged against the lexicon, where the last word of a text line and the
first of the next, perhaps on the next page, are judged together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lipimala.llm.line_model import EDGE, LineModel, codes_of, fit, title_keys
from lipimala.runtime import BROADCAST_ROWS, cut, maybe_broadcast, pick, small, uncut

# Signs that part a word at a line's end, and marks that may stand at a word's ends.
PARTING = "-‐¬=\xad"
MARKS = ",.!;?:।॥|—–-‐\"'“”‘’()[]…"
#: Words judged once and remembered by a worker.
REMEMBER = 1 << 18
#: Pages per block when neighbours are looked up, and pages that the line model is fitted to.
PAGE_BLOCK, FIT_PAGES = 256, 2000
#: Pages on which a running title recurs, and share of its lines that stand within three lines of a page's edge.
TITLE_PAGES, TITLE_EDGE = 2, 0.6

_NUMBER = regex.compile(r"[0-9౦-౯]+(?:[-–:./,][0-9౦-౯]+)*|⟦#\d+⟧")
_HYPHEN = regex.compile("[-‐]")
_LETTERS = regex.compile(r"[\p{L}\p{M}]")


# --- words -------------------------------------------------------------------------------------------


class Words:
    """What is a good word: one of the lexicon, or two of them run together or with a hyphen."""

    def __init__(self, words: list[str]) -> None:
        self.words = frozenset(words)
        self.starts = frozenset(w[:i] for w in self.words for i in range(1, len(w) + 1))
        self.ends = frozenset(w[i:] for w in self.words for i in range(len(w)))
        self.shorter: dict[str, list[str]] = {}
        for w in self.words:
            for i in range(len(w)):
                self.shorter.setdefault(w[:i] + w[i + 1 :], []).append(w)
        self._good: dict[str, bool] = {}
        self._misread: dict[str, bool] = {}

    def good(self, word: str) -> bool:
        known = self._good.get(word)
        if known is None:
            if len(self._good) > REMEMBER:
                self._good.clear()
            known = word in self.words or any(word[:i] in self.words and word[i:] in self.words for i in range(1, len(word)))
            self._good[word] = known
        return known

    def near_one(self, word: str) -> set[str]:
        """Words of the lexicon that one inserted, lost or changed character, or one split in two, makes of ``word``."""
        found = set(self.shorter.get(word, ()))
        cuts = [word[:i] + word[i + 1 :] for i in range(len(word))]
        found.update(c for c in cuts if c in self.words)
        found.update(w for c in cuts for w in self.shorter.get(c, ()) if abs(len(w) - len(word)) == 0)
        found.update(c for i in range(len(word) - 1) for c in self.shorter.get(word[:i] + word[i + 2 :], ()) if len(c) == len(word) - 1)
        return found

    def begins(self, part: str) -> bool:
        """Whether some good word begins with ``part``."""
        return part in self.starts or any(part[:i] in self.words and part[i:] in self.starts for i in range(1, len(part)))

    def ends_with(self, part: str) -> bool:
        return part in self.ends or any(part[:i] in self.ends and part[i:] in self.words for i in range(1, len(part)))

    def misread(self, token: str) -> bool:
        """Whether the word between its marks is neither good nor a number."""
        known = self._misread.get(token)
        if known is None:
            if len(self._misread) > REMEMBER:
                self._misread.clear()
            known = self._misread[token] = self._judged(token)
        return known

    def _judged(self, token: str) -> bool:
        core = token.strip(MARKS + "\xad")
        if not core or core in self.words or _NUMBER.fullmatch(core) or self.good(core):
            return False
        parts = _HYPHEN.split(core)
        return not (len(parts) > 1 and all(p in self.words for p in parts))

    def repaired(self, token: str) -> str:
        """The token with its one nearest lexicon word, where there is just one."""
        core = token.strip(MARKS + "\xad")
        near = self.near_one(core) if core else set()
        return token.replace(core, near.pop()) if len(near) == 1 else token

    def across(self, a: str, b: str | None) -> tuple[bool, bool, bool]:
        """For a line's last token and the next line's first (null: none known): is a word cut there, and
        is the first, the second token misread.

        A word is cut where both tokens together are one good word and a sign of parting stands between them, or
        no sign and not both are good alone. Two words of the lexicon at a hyphen are a compound, also if one of them is misread. With a sign,
        a word that is not good together is cut as well, and the half that neither begins nor ends a good word is
        misread. Without a cut both tokens are judged alone.
        """
        alone = (False, self.misread(a), b is not None and self.misread(b))
        first = a.strip(MARKS.replace("-", "").replace("‐", ""))
        stem = first.rstrip(PARTING)
        sign = first[len(stem) :]
        *before, p = _HYPHEN.split(stem.lstrip(MARKS))
        if not p or not _LETTERS.search(stem[-1]) or _NUMBER.fullmatch(stem):
            return alone
        q, *after = _HYPHEN.split(b.strip(MARKS + "\xad")) if b else ("",)
        behind, beyond = (any(x not in self.words for x in parts) for parts in (before, after))  # the other words of a compound
        if not q or b[0] in MARKS or not _LETTERS.search(q[0]):  # what goes on there is unknown
            if sign and (sign != "-" or p not in self.words):
                return True, behind or not self.begins(p), alone[2]
            if not sign and b is None and a == a.rstrip(MARKS) and not self.good(p) and p in self.starts:
                return True, behind, False
            return (False, behind or not self.good(p), alone[2]) if sign else alone
        if sign == "-" and p in self.words and q in self.words:
            return False, behind, beyond
        if sign == "-" and not self.good(p + q) and any(x in self.words and self.near_one(y) for x, y in ((p, q), (q, p))):
            return False, behind or p not in self.words, beyond or q not in self.words
        if sign:
            return True, behind or not (self.good(p + q) or self.begins(p)), beyond or not (self.good(p + q) or self.ends_with(q))
        if (alone[1] or alone[2]) and a == a.rstrip(MARKS) and self.good(p + q):
            return True, behind, beyond
        return alone


_WORDS: dict[bytes, Words] = {}


def _words(text: str) -> Words:
    """The worker process's lexicon, built once."""
    key = hashlib.sha256(text.encode()).digest()
    if key not in _WORDS:
        _WORDS.clear()
        _WORDS[key] = Words([w for w in text.split("\n") if w])
    return _WORDS[key]


def _lexicon(lexicon: DataFrame):
    """A broadcast of the reference lexicon; its size is counted first."""
    words = pick(lexicon, "word").where("word <> ''").distinct()
    if not small(words):
        raise ValueError(f"the lexicon has more than {BROADCAST_ROWS} words, which is too much to broadcast")
    return lexicon.sparkSession.sparkContext.broadcast("\n".join(sorted(r[0] for r in words.collect())))


# --- lines -------------------------------------------------------------------------------------------


def _line_titles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(book, page, title, edge): what of a page's lines may be a title, and whether it stands at an edge."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            shown = [x for x in row["lines"] or [] if x and x.strip()]
            found: dict[str, bool] = {}
            for k, line in enumerate(shown):
                for key in title_keys(line, row["page"]):
                    found[key] = found.get(key, False) or k < EDGE or k >= len(shown) - EDGE
            out += [(row["book"], row["page"], t, int(e)) for t, e in found.items()]
        columns = [list(x) for x in zip(*out, strict=True)] or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int32()), strict=True)], names=["book", "page", "title", "edge"])


def running_titles(pages: DataFrame) -> DataFrame:
    """(book, titles): what recurs on a book's pages, mostly at their edges."""
    seen = pages.select("book", "page", "lines").mapInArrow(_line_titles, "book string, page int, title string, edge int")
    often = seen.groupBy("book", "title").agg(F.count("*").alias("n"), F.avg("edge").alias("edge")).where((F.col("n") >= TITLE_PAGES) & (F.col("edge") >= TITLE_EDGE))
    return often.groupBy("book").agg(F.array_sort(F.collect_list("title")).alias("titles"))


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = [codes_of(row["lines"] or [], row["page"], row["titles"] or []) for row in batch.to_pylist()]
        keep = [i for i, name in enumerate(batch.schema.names) if name != "titles"]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(codes, pa.list_(pa.int32()))], names=[*(batch.schema.names[i] for i in keep), "codes"])


def code_pages(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """``pages`` (book, page, lines and more) with the codes of their lines."""
    known = pages.join(maybe_broadcast(titles), "book", "left")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.schema.fields if f.name != "titles")
    return known.mapInArrow(_coded, f"{ddl}, codes array<int>")


def fitted_model(coded: DataFrame, sample: int = FIT_PAGES) -> LineModel:
    """The line model, fitted to the codes of at most ``sample`` pages, taken in the order of a hash of their key."""
    rows = coded.where(F.size("codes") > 0).select("codes", F.xxhash64("book", "page").alias("at"), "book", "page").orderBy("at", "book", "page").limit(sample)
    return fit([list(r.codes) for r in rows.select("codes").collect()])


def _labelled(model: LineModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, heads, tails = [], [], []
            for row in batch.to_pylist():
                lines = row["lines"] or []
                found = model.label(row["codes"] or [])
                text = [x.split() for x, kind in zip(lines, found, strict=True) if kind == "body"]
                labels.append(found)
                heads.append(text[0][0] if text else None)
                tails.append(text[-1][-1] if text else None)
            keep = [i for i, name in enumerate(batch.schema.names) if name != "codes"]
            extra = [pa.array(labels, pa.list_(pa.string())), pa.array(heads, pa.string()), pa.array(tails, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *extra], names=[*(batch.schema.names[i] for i in keep), "labels", "head", "tail"])

    return run


def label_pages(coded: DataFrame, model: LineModel) -> DataFrame:
    """Pages with codes as pages with labels, and the first and last word of their text."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields if f.name != "codes")
    return coded.mapInArrow(_labelled(model), f"{ddl}, labels array<string>, head string, tail string")


def neighbours(labelled: DataFrame) -> DataFrame:
    """(book, page, before, after, before_page, after_page): the last word of the text before a page, the first
    of the text after, and their pages.

    Pages without text are passed over. Looked up within blocks of pages first and between blocks then, so
    that a long book is not one task's work.
    """
    tail, head = (F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("word"), "page")) for c in ("tail", "head"))
    rows = labelled.select("book", "page", tail.alias("tail"), head.alias("head"))
    found = _beside(rows, ["book"], "tail", "before").join(_beside(rows, ["book"], "head", "after", True), ["book", "page"])
    return found.select("book", "page", "before.word", "after.word", "before.page", "after.page").toDF("book", "page", "before", "after", "before_page", "after_page")


def _beside(rows: DataFrame, keys: list[str], value: str, name: str, following: bool = False) -> DataFrame:
    """(keys, page, ``name``): the nearest ``value`` that isn't null on the pages before, or on those following."""
    order = (lambda c: F.col(c).desc()) if following else F.col
    rows = rows.select(*keys, "page", value, F.floor(F.col("page") / PAGE_BLOCK).alias("block"))
    nearest = F.min_by if following else F.max_by
    blocks = rows.groupBy(*keys, "block").agg(nearest(value, F.when(F.col(value).isNotNull(), F.col("page"))).alias("last"))
    inside, between = (Window.partitionBy(*keys, *more).orderBy(order(by)).rowsBetween(Window.unboundedPreceding, -1) for more, by in ((["block"], "page"), ([], "block")))
    far = blocks.select(*keys, "block", F.last("last", True).over(between).alias("far"))
    near = rows.select(*keys, "page", "block", F.last(value, True).over(inside).alias("near"))
    return near.join(far, [*keys, "block"]).select(*keys, "page", F.coalesce("near", "far").alias(name))


# --- noise -------------------------------------------------------------------------------------------


def judge(text: list[list[str | None]], before: str | None, after: str | None, words: Words) -> list[list[tuple[bool, bool]]]:
    """(broken, misread) of every token of the text lines of a page; a null token is neither."""
    verdict = [[(False, False) if t is None else (False, words.misread(t)) for t in line] for line in text]
    if text and before is not None and text[0][0] is not None:
        cut_, _, second = words.across(before, text[0][0])
        if len(text) > 1 or len(text[0]) > 1 or cut_:
            verdict[0][0] = (False, second)
    for k, line in enumerate(text):
        if line[-1] is None:
            continue
        following = text[k + 1][0] if k + 1 < len(text) else after
        cut_, first, second = words.across(line[-1], following)
        if len(line) == 1:  # its first word may have been judged with the line before
            first = first and verdict[k][0][1]
        verdict[k][-1] = (cut_, first)
        if k + 1 < len(text) and following is not None:
            verdict[k + 1][0] = (False, second)
    return verdict


_NOISE = "book string, page int, item bigint, kind string"
_NOISE_TYPES = (pa.string(), pa.int32(), pa.int64(), pa.string())


def _noise_rows(out: list[tuple]) -> pa.RecordBatch:
    columns = [list(x) for x in zip(*out, strict=True)] or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _NOISE_TYPES, strict=True)], names=["book", "page", "item", "kind"])


def _page_noise(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(lexicon.value)
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                numbers = [i for i, kind in enumerate(row["labels"]) if kind == "body"]
                for i, kind in enumerate(row["labels"], 1):
                    if kind in ("header", "footer"):
                        out.append((row["book"], row["page"], i, "furniture"))
                verdict = judge([row["lines"][i].split() for i in numbers], row["before"], row["after"], words)
                for i, line in zip(numbers, verdict, strict=True):
                    if line[-1][0]:
                        out.append((row["book"], row["page"], i + 1, "broken"))
                    if any(bad for _, bad in line):
                        out.append((row["book"], row["page"], i + 1, "misread"))
            yield _noise_rows(out)

    return run


def _word_noise(lexicon, model: LineModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(lexicon.value)
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                lines = ocr_lines(row["words"])
                labels = model.label(codes_of([" ".join(w["text"] or "…" for w in line) for line in lines], row["page"], row["titles"] or []))
                body = [line for line, kind in zip(lines, labels, strict=True) if kind == "body"]
                out += [(row["book"], row["page"], w["ocr_no"], "furniture") for line, kind in zip(lines, labels, strict=True) if kind in ("header", "footer") for w in line]
                verdict = judge([[(w["text"] or "").strip() or None for w in line] for line in body], row["before"], row["after"], words)
                for line, judged in zip(body, verdict, strict=True):
                    for w, (broken, bad) in zip(line, judged, strict=True):
                        out += [(row["book"], row["page"], w["ocr_no"], kind) for kind, yes in (("broken", broken), ("misread", bad)) if yes]
            yield _noise_rows(out)

    return run


def ocr_lines(words: list[dict]) -> list[list[dict]]:
    """Words in reading order as lines: a new one begins where a word's middle lies below the line so far."""
    lines: list[list[dict]] = []
    bottom = None
    for w in words:
        top, low = w["y0"], w["y1"]
        if not lines or (bottom is not None and top is not None and (top + low) / 2 > bottom):
            lines.append([])
            bottom = None
        lines[-1].append(w)
        if low is not None:
            bottom = low if bottom is None else max(bottom, low)
    return lines


def _event_noise(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(lexicon.value)
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                reading, converted = (row["ocr_text"] or "").strip(), row["converted"] or ""
                broken, bad = judge_reading(reading, converted, words)
                out += [(row["book"], row["page_number"], row["event_id"], kind) for kind, yes in (("broken", broken), ("misread", bad)) if yes]
            yield _noise_rows(out)

    return run


def judge_reading(reading: str, converted: str, words: Words) -> tuple[bool, bool]:
    """(broken, misread) of a single reading beside its conversion, in which ⟦ ⟧ stands for any characters."""
    stem = reading.rstrip(PARTING)
    if len(stem) == len(reading) or not stem or not _LETTERS.search(stem[-1]):
        return False, bool(reading) and words.misread(reading)
    parts = converted.split("-")
    if len(parts) == 2 and parts[0] == stem and all(p in words.words for p in parts):
        return False, False
    pattern = "".join(".+" if p.startswith("⟦") else regex.escape(p) for p in regex.findall(r"⟦[^⟧]*⟧|[^⟦]+", converted))
    as_converted = bool(pattern) and regex.compile(pattern).fullmatch(stem, partial=True) is not None
    return True, not (as_converted and words.begins(stem.split("-")[-1]) or (not converted and words.begins(stem)))


def scan_noise(pages: DataFrame, ocr: DataFrame, events: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(src, book, page, item, kind) of all noise in scanned pages, OCR words and single readings.

    Repeated rows count once. Null or empty lines, pages and readings hold no noise. An OCR page's first
    and last words are judged with its book's neighbouring scanned pages.
    """
    known = _lexicon(lexicon)
    once = pick(pages, "book", "page", "lines").dropDuplicates(["book", "page"])
    titles = cut(running_titles(once), "titles")
    coded = cut(code_pages(once, titles), "coded")
    model = fitted_model(coded)
    labelled = cut(label_pages(coded, model), "labelled")
    uncut(coded)
    around = neighbours(labelled)
    scans = labelled.join(around, ["book", "page"]).select("book", "page", "lines", "labels", "before", "after").mapInArrow(_page_noise(known), _NOISE)
    words = pick(ocr, "book", "page", "ocr_no", "text", "bbox").select("book", "page", "ocr_no", "text", F.col("bbox.y0").alias("y0"), F.col("bbox.y1").alias("y1")).repartition("book", "page").dropDuplicates(["book", "page", "ocr_no"])
    sheets = words.groupBy("book", "page").agg(F.array_sort(F.collect_list(F.struct("ocr_no", "text", "y0", "y1"))).alias("words"))
    sheets = sheets.join(around, ["book", "page"], "left").join(maybe_broadcast(titles), "book", "left")
    read = sheets.select("book", "page", "words", "titles", "before", "after").mapInArrow(_word_noise(known, model), _NOISE)
    single = pick(events, "event_id", "book", "page_number", "converted", "ocr_text").dropDuplicates(["event_id"]).mapInArrow(_event_noise(known), _NOISE)
    return scans.withColumn("src", F.lit("scan_pages")).unionByName(read.withColumn("src", F.lit("ocr_words"))).unionByName(single.withColumn("src", F.lit("learn_events"))).select("src", "book", "page", "item", "kind").distinct()


# --- paragraphs --------------------------------------------------------------------------------------


_PARAGRAPHS = "src string, book string, page int, texts array<string>, opens boolean, runs_on boolean"


def _paragraphs(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(lexicon.value)
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                lines, labels, before, after = row["lines"] or [], row["labels"], row["before"], row["after"]
                texts = page_paragraphs(lines, labels, before, after, words, row["begun"])
                out.append((row["src"], row["book"], row["page"], texts, *_open_ends(lines, labels, before, after, texts, words)))
            columns = [list(x) for x in zip(*out, strict=True)] or [[]] * 6
            kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["src", "book", "page", "texts", "opens", "runs_on"])

    return run


def _open_ends(lines: list[str | None], labels: list[str], before: str | None, after: str | None, texts: list[str], words: Words) -> tuple[bool, bool]:
    """Whether the page's first paragraph may go on from the page before, and its last on the page after."""
    body = [i for i, kind in enumerate(labels) if kind == "body"]
    if not body:
        return False, False
    first, last = lines[body[0]].split(), lines[body[-1]].split()
    skip = before is not None and words.across(before, first[0])[0]
    opens = skip or "break" not in labels[: body[0]]
    if skip and len(first) == 1 and len(body) > 1:  # the page's own text begins in the next line
        opens = "break" not in labels[body[0] : body[1]]
    cut_ = words.across(last[-1], after)[0]
    return opens, (cut_ or "break" not in labels[body[-1] :]) and not (texts[-1] if texts else last[-1]).endswith("॥")


def page_paragraphs(lines: list[str | None], labels: list[str], before: str | None, after: str | None, words: Words, begun: bool = False) -> list[str]:
    """The page's text as paragraphs: furniture gone, cut words whole, misread words repaired where one
    lexicon word is nearest. A word cut at the page's end is completed here and left out on the next page;
    ``begun``: the page before is not given, so a word cut there is completed on this page. A paragraph ends at a break and after a stanza's end."""
    rows = [(i, (lines[i] or "").split()) for i, kind in enumerate(labels) if kind == "body"]
    verdict = judge([r for _, r in rows], before, after, words)
    skip = bool(rows) and before is not None and words.across(before, rows[0][1][0])[0]
    out: list[list[str]] = [[]]
    carry = before.strip(MARKS).rstrip(PARTING) if skip and begun else ""
    skip = skip and not begun
    for k, (i, tokens) in enumerate(rows):
        if k and not carry and "break" in labels[rows[k - 1][0] : i] and out[-1]:
            out.append([])
        shown = tokens[1:] if k == 0 and skip else tokens
        for j, token in enumerate(shown, len(tokens) - len(shown)):
            broken, bad = verdict[k][j]
            token, carry = carry + token, ""
            if broken:
                carry = token.rstrip(PARTING)
            else:
                out[-1].append(words.repaired(token) if bad or words.misread(token) else token)
        if out[-1] and out[-1][-1].endswith("॥") and not carry:
            out.append([])
    if carry:
        out[-1].append(carry + (after or ""))
    return [" ".join(p) for p in out if p]


def _sheet_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(book, page, lines) of OCR pages; an unread word is shown as an ellipsis."""
    for batch in batches:
        lines = [[" ".join((w["text"] or "").strip() or "…" for w in line) for line in ocr_lines(row["words"])] for row in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["book"], batch["page"], pa.array(lines, pa.list_(pa.string()))], names=["book", "page", "lines"])


def readable_paragraphs(pages: DataFrame, lexicon: DataFrame, ocr: DataFrame | None = None) -> DataFrame:
    """(src, book, page, paragraph, text, start_page, start_paragraph) of every page with text.

    A paragraph that runs over pages has a row on each, with the place where it starts. Texts of scanned and
    of OCR pages are given apart; a word cut at a page's end is completed from the other source where its own
    has no page beside. OCR words show no blank lines, so their paragraphs end at stanzas only.
    """
    known = _lexicon(lexicon)
    once = pick(pages, "book", "page", "lines").dropDuplicates(["book", "page"])
    titles = cut(running_titles(once), "titles")
    every = code_pages(once, titles).withColumn("src", F.lit("scan_pages"))
    if ocr is not None:
        words = pick(ocr, "book", "page", "ocr_no", "text", "bbox").select("book", "page", "ocr_no", "text", F.col("bbox.y0").alias("y0"), F.col("bbox.y1").alias("y1")).repartition("book", "page").dropDuplicates(["book", "page", "ocr_no"])
        sheets = words.groupBy("book", "page").agg(F.array_sort(F.collect_list(F.struct("ocr_no", "text", "y0", "y1"))).alias("words"))
        sheets = sheets.mapInArrow(_sheet_lines, "book string, page int, lines array<string>")
        every = every.unionByName(code_pages(sheets, titles).withColumn("src", F.lit("ocr_words")))
    coded = cut(every, "coded")
    every = cut(label_pages(coded, fitted_model(coded.where("src = 'scan_pages'"))), "labelled")
    uncut(coded)
    uncut(titles)
    first = lambda c: F.coalesce(F.max(F.when(F.col("src") == "scan_pages", F.col(c))), F.max(c)).alias(c)
    around = neighbours(every.groupBy("book", "page").agg(first("head"), first("tail")))
    text = every.where("head is not null")
    own_before = text.select("src", "book", F.col("page").alias("before_page"), F.col("tail").alias("own_before"))
    own_after = text.select("src", "book", F.col("page").alias("after_page"), F.col("head").alias("own_after"))
    rows = text.join(around, ["book", "page"]).join(own_before, ["src", "book", "before_page"], "left").join(own_after, ["src", "book", "after_page"], "left")
    begun = F.col("own_before").isNull()
    rows = rows.select("src", "book", "page", "lines", "labels", F.coalesce("own_before", "before").alias("before"), F.coalesce("own_after", "after").alias("after"), begun.alias("begun"), "before_page")
    whole = cut(rows.drop("before_page").mapInArrow(_paragraphs(known), _PARAGRAPHS), "paragraphs")
    before = whole.select("src", "book", F.col("page").alias("before_page"), F.col("runs_on").alias("came"))
    flow = whole.select("src", "book", "page", "opens", F.size("texts").alias("n")).join(rows.select("src", "book", "page", "before_page"), ["src", "book", "page"]).join(before, ["src", "book", "before_page"], "left")
    flow = flow.select("src", "book", "page", "n", (F.col("opens") & F.coalesce("came", F.lit(False))).alias("goes_on"))
    anchor = F.when((F.col("n") > 1) | ((F.col("n") == 1) & ~F.col("goes_on")), F.struct(F.col("page").alias("p"), F.col("n").alias("k")))
    starts = _beside(flow.withColumn("anchor", anchor), ["src", "book"], "anchor", "start").join(flow, ["src", "book", "page"])
    found = whole.join(starts.select("src", "book", "page", F.when(F.col("goes_on"), F.col("start")).alias("start")), ["src", "book", "page"])
    found = found.select("src", "book", "page", "start", F.posexplode("texts").alias("k", "text")).withColumn("paragraph", F.col("k") + 1)
    start = F.when(F.col("paragraph") == 1, F.col("start"))
    return found.select("src", "book", "page", "paragraph", "text", F.coalesce(start["p"], "page").alias("start_page"), F.coalesce(start["k"], "paragraph").alias("start_paragraph"))
