"""Pages made of repeated keywords, link lists, tags or product lines instead of sentences.

The lines of a text are labelled by a hidden Markov model with the states prose, keyword list, link list,
tag list and menu. A line's emission scores come from the line (share of addresses, of tags, of table cells;
length and end) and from how often words recur around it; staying in a state costs nothing, so a bare label
between two addresses belongs to the link list. A page is flagged by the share of its words that stand in
lines which are not prose.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lipimala.runtime import pick

STATES = ("prose", "keywords", "links", "tags", "menu")
#: Words of a window in which recurrence is measured, recurrence that speaks for neither, cost of a change
#: of state, longest bare label in words, and the share of words from which a page is flagged.
WINDOW, RECURRENCE, CHANGE, LABEL, SHARE = 40, 0.08, 2.0, 4, 0.5
FEW = 14

_BREAK = regex.compile("\r\n|[\n\r\v\f\x85  ]")
_NO_INK = regex.compile(r"\p{Cf}+")
_TAGGED = regex.compile(r"<[^>]*>")
_ADDRESS = regex.compile(r"(?:https?://|www\.)\S+|[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}(?:/\S*|\b)", regex.IGNORECASE)
_WORD = regex.compile(r"[\p{L}\p{M}]+(?:[-'.0-9][\p{L}\p{M}]+)*")
_TAG = regex.compile(r"(?<!\S)(?:#|tag:)\S+|\S+\s*\(\d+\)", regex.IGNORECASE)
_CELL = regex.compile(r"\|\s*[^\s\d|]{0,3}\s?\d+(?:[.,]\d+)?\s*[^\s\d|]{0,3}\s*(?=\|)")
# Digits written for letters.
_DIGIT_LETTERS = str.maketrans("0134578", "oleastb")
_DISGUISED = regex.compile(r"[a-z][a-z\d]*\d[a-z\d]*|\d+[a-z][a-z\d]*")
_ENDED = regex.compile(r"[.?!।॥…:;][\"'”’)]*\s*$")


def recurrence(types: list[str]) -> float:
    """Chance that two of the words are the same (Simpson's index without bias); few words count as more
    words without recurrence, as three articles of a short sentence say nothing."""
    n = max(len(types), FEW)
    return sum(c * (c - 1) for c in Counter(types).values()) / (n * (n - 1))


def _undisguised(match: regex.Match) -> str:
    """A word without the digits written for its letters or put behind it: n3w, fr33 and pack7 are new, free and pack."""
    return match[0].rstrip("12456789").translate(_DIGIT_LETTERS)


class Line:
    """What the model sees of a line."""

    __slots__ = ("addresses", "cells", "ended", "recurs", "size", "tags", "words")

    def __init__(self, text: str) -> None:
        held = [x for t in _TAGGED.findall(text) for x in _ADDRESS.findall(t)] if "<" in text else []
        shown = _TAGGED.sub(" ", text) if "<" in text else text
        self.addresses = len(held)
        if "." in shown:
            shown, n = _ADDRESS.subn(" ", shown)
            self.addresses += n
        self.tags = len(_TAG.findall(shown)) if "#" in shown or "(" in shown or ":" in shown else 0
        self.cells = len(_CELL.findall(shown)) if "|" in shown else 0
        self.words = _WORD.findall(_DISGUISED.sub(_undisguised, shown.lower()))
        self.size = len(self.words) + self.addresses
        self.ended = _ENDED.search(shown) is not None
        self.recurs = 0.0

    def scores(self) -> tuple[float, ...]:
        """Log-emission of each state, against prose at 0 for an ordinary sentence."""
        n = max(1, self.size)
        label = 0 < self.size <= LABEL and not self.ended
        other = -0.5 if label else -6.0
        links = min(6.0, 12 * self.addresses / n) - 1 if self.addresses / n > 0.15 else other
        tags = min(6.0, 8 * self.tags / n) - 0.5 if self.tags / n > 0.25 else other
        menu = 5.0 if self.cells and self.cells * 12 >= n else other
        keywords = max(-6.0, min(6.0, (self.recurs - RECURRENCE) * 120))
        return (-1.5 if label else 0.0, keywords, links, tags, menu)


def label_text(text: str) -> list[tuple[str, int]]:
    """(state, words) of every line with words: the best path of the model."""
    lines = [x for t in _BREAK.split(_NO_INK.sub("", text)) if t.strip() and (x := Line(t)).size]
    if not lines:
        return []
    stream = [w for x in lines for w in x.words]
    at = 0
    for x in lines:
        begin, end = at, at + len(x.words)
        at = end
        if end - begin >= WINDOW:
            whole, rest = divmod(end - begin, WINDOW)
            x.recurs = sum(recurrence(stream[i : i + WINDOW]) for i in range(begin, end - rest, WINDOW)) * WINDOW
            if rest:  # a last window ends with the line and counts for the words that are new in it
                x.recurs += recurrence(stream[end - WINDOW : end]) * rest
            x.recurs /= whole * WINDOW + rest
        else:
            middle = (begin + end) // 2
            low = max(0, min(middle - WINDOW // 2, len(stream) - WINDOW))
            x.recurs = recurrence(stream[low : low + WINDOW])
    best = list(lines[0].scores())
    back: list[list[int]] = []
    for x in lines[1:]:
        top = max(range(len(STATES)), key=best.__getitem__)
        came = [s if best[s] >= best[top] - CHANGE else top for s in range(len(STATES))]
        best = [max(best[s], best[top] - CHANGE) + e for s, e in enumerate(x.scores())]
        back.append(came)
    state = max(range(len(STATES)), key=best.__getitem__)
    path = [state]
    for came in reversed(back):
        state = came[state]
        path.append(state)
    return [(STATES[s], x.size) for s, x in zip(reversed(path), lines, strict=True)]


def other_share(text: str | None) -> float | None:
    """Share of the words outside prose; null for a text without words."""
    labelled = label_text(text) if text else []
    total = sum(n for _, n in labelled)
    return sum(n for state, n in labelled if state != "prose") / total if total else None


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shares = [other_share(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shares, pa.float64())], names=["ident", "other_share"])


def text_shares(documents: DataFrame, ident: str, text: str) -> DataFrame:
    """(``ident``, other_share) of every row, without a shuffle; null for null, empty and wordless texts."""
    rows = pick(documents, ident, text).toDF("ident", "text")
    kind = rows.schema["ident"].dataType.simpleString()
    return rows.mapInArrow(_shares, f"ident {kind}, other_share double").withColumnRenamed("ident", ident)


def spam_pages(documents: DataFrame, ident: str, text: str, *, share: float = SHARE) -> DataFrame:
    """``ident`` of the rows of which more than ``share`` of the words are no prose, each once.

    Labels are made before repeated rows are removed, so that no text is ever shuffled.
    """
    return text_shares(documents, ident, text).where(F.col("other_share") > share).select(ident).distinct()
