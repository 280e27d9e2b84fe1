"""Labels of a page's lines by a hidden Markov model: header, body, break and footer.

A line is seen as one of a few codes made of layout features: where it stands on the page, whether a number at
one of its ends is the page's, and what the rest of it is: nothing, a title that recurs on the book's pages,
words without or words with the marks of sentences. The tables of the model are fitted by expectation
maximisation (Baum and Welch) to a bounded sample of pages, in which the lines that leave no doubt are labelled:
lines without a number that recur on no page are body, the page's number alone or beside a recurring title is furniture. The
fitting begins from rough guesses that count as a few pages seen. Labels are for the fitting only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import zip_longest

import numpy as np
import regex

HEADER, BODY, BREAK, FOOTER = range(4)
STATES = ("header", "body", "break", "footer")
#: Lines from a page's edge that have a place of their own, weight of the first guesses in lines, rounds of fitting.
EDGE, PRIOR, ROUNDS = 3, 200.0, 12

# Characters read for digits, and the digits.
DIGIT_LIKE = str.maketrans("౦౧౨౩౪౫౬౭౮౯OoDQlI|i!ZzSsBgqbGT", "01234567890000111112255899667")
_DIGITS = frozenset("0123456789" + "".join(map(chr, DIGIT_LIKE)))
_DECORATION = "-–—‐.*~_()[]|:{}<>·•"
_STROKED = _DECORATION.replace("|", "")
_DASH = regex.compile(r"\s[—–-]+\s")
_CUT = regex.compile(r"[\p{L}\p{M}][-‐¬=\xad]\s*$")
_MARKS = regex.compile(r"[,.!;?।॥]")
_ENDED = regex.compile(r"[,.!;?।॥](?=\s|$)|॥")

#: What a line's number is, what its rest is, and where it stands.
NO_NUMBER, LIKE_NUMBER, PAGE_NUMBER = range(3)
NOTHING, TITLE, PLAIN, TEXT = range(4)
KINDS, PLACES = 12, 2 * EDGE + 1


def bare(token: str) -> str:
    return token.strip(_DECORATION)


def _digits(token: str) -> str | None:
    """The number that a token may have been: at least one true digit, or nothing but signs like digits."""
    if token[:1] not in _DIGITS:
        return None
    value = token.translate(DIGIT_LIKE)
    return value if value.isdecimal() and value.isascii() and (len(token) <= 4 or any(c.isdecimal() for c in token)) else None


def _fit(value: str, page: int) -> int:
    """How well a number is the page's: 2 it is, 1 half of its digits are, 0 it isn't."""
    want = str(page)
    if (value.lstrip("0") or "0") == want:
        return 2
    return int(len(value) == len(want) and sum(x == y for x, y in zip(value, want, strict=True)) * 2 >= len(want))


def _live(token: str) -> bool:
    return bool(bare(token)) or "|" in token


def _number(tokens: list[str], page: int | None) -> tuple[int, int | None]:
    """(number, place): how well one of the first two or last two tokens is the page's number, and which."""
    there, n = [i for i in range(min(len(tokens), 4)) if _live(tokens[i])][:2], len(tokens)
    back = [i for i in range(n - 1, max(n - 5, -1), -1) if _live(tokens[i])][:2]
    ends = list(dict.fromkeys(x for pair in zip_longest(there, back) for x in pair if x is not None))
    alone = len(ends) == 1 and sum(map(_live, tokens)) == 1
    best, place = NO_NUMBER, None
    for i in ends:
        word = bare(tokens[i]) or tokens[i]
        stroked = tokens[i].strip(_STROKED) if "|" in tokens[i] else word  # a stroke may have been a one
        values = [v for x in {word, stroked} if (v := _digits(x)) is not None]
        if not values:
            continue
        fit = max(_fit(v, page) for v in values) if page is not None else 0
        found = PAGE_NUMBER if fit == 2 else LIKE_NUMBER if fit or alone else NO_NUMBER
        if found > best:
            best, place = found, i
    if best == NO_NUMBER and page is not None:  # a number with signs that are none of the known
        want = str(page)
        for i in ends[:2]:
            word = bare(tokens[i]) or tokens[i]
            if len(word) == len(want) and any(c.isdecimal() for c in word) and sum(x == y for x, y in zip(word.translate(DIGIT_LIKE), want, strict=True)) * 2 >= len(want):
                best, place = LIKE_NUMBER, i
    return best, place


def parted(line: str, page: int | None) -> tuple[int, list[str]]:
    """(number, rest): how well a number at an end of the line is the page's, and the other words.

    The number may have one word before or behind it that stays with the rest.
    """
    tokens = line.split()
    number, place = _number(tokens, page)
    return number, [w for i, t in enumerate(tokens) if i != place and (w := bare(t))]


def title_keys(line: str, page: int | None) -> list[str]:
    """What of a line may recur as a title: its words but for the number, and those before a dash."""
    if _ENDED.search(line) or _CUT.search(line) or not line.strip():
        return []
    keys = [" ".join(parted(line, page)[1])]
    before = _DASH.split(" " + line.strip(" " + _DECORATION) + " ", maxsplit=1)
    if len(before) > 1:
        keys.append(" ".join(parted(before[0], page)[1]))
        number, rest = parted(before[1], page)
        if number:
            keys.append(" ".join(rest))
    return [k for k in dict.fromkeys(keys) if k and not k.isdecimal()]


@lru_cache(1 << 14)
def _places(text: str) -> dict[str, int]:
    """For every character a number with a bit for each place it stands at."""
    places: dict[str, int] = {}
    for i, c in enumerate(text):
        places[c] = places.get(c, 0) | 1 << i
    return places


def distance(a: str, b: str, most: int) -> int:
    """Edit distance, or ``most`` + 1 where it is larger; a column of the table is two numbers (Myers, 1999)."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not b:
        return len(a)
    places, whole, top, d = _places(b), (1 << len(b)) - 1, 1 << (len(b) - 1), len(b)
    up, down = whole, 0  # where the column rises and falls
    for c in a:
        same = places.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        rise, fall = down | (whole & ~(diagonal | up)), up & diagonal
        d += bool(rise & top) - bool(fall & top)
        rise = (rise << 1 | 1) & whole
        up, down = ((fall << 1) & whole) | (whole & ~(same | down | rise)), rise & (same | down)
    return min(d, most + 1)


def is_title(keys: list[str], titles: list[str]) -> bool:
    """Whether one of the keys is a title or, but for a quarter of its characters, like one."""
    if not titles:
        return False
    if not set(keys).isdisjoint(titles):
        return True
    return any(distance(k, t, max(1, len(t) // 4)) <= max(1, len(t) // 4) for k in keys for t in titles)


def kind_of(line: str, page: int | None, titles: list[str]) -> int:
    """The code of a line that isn't blank, but for its place."""
    marks, cut = len(_ENDED.findall(line)), _CUT.search(line) is not None
    number, _ = _number(line.split(), page)
    if cut or marks > 1:
        return number * 4 + TEXT
    if marks:  # a mark may be dirt
        keys = title_keys(_MARKS.sub("", line), page)
        return number * 4 + (TITLE if is_title(keys, titles) else TEXT)
    if not parted(line, page)[1]:
        return number * 4 + NOTHING
    keys = title_keys(line, page)
    return number * 4 + (TITLE if is_title(keys, titles) else PLAIN if keys else TEXT)


def codes_of(lines: list[str | None], page: int | None, titles: list[str]) -> list[int]:
    """Code of every line: kind and place, or -1 for a blank one."""
    shown = [i for i, x in enumerate(lines) if x and x.strip()]
    codes, n = [-1] * len(lines), len(shown)
    for k, i in enumerate(shown):
        from_end = n - 1 - k
        place = k if k < EDGE and k <= from_end else 2 * EDGE - from_end if from_end < EDGE else EDGE
        codes[i] = kind_of(lines[i], page, titles) * PLACES + place
    return codes


@dataclass
class LineModel:
    """Log-probabilities of the first state, of changes, of kinds and of places."""

    first: np.ndarray
    change: np.ndarray
    kind: np.ndarray
    place: np.ndarray

    def __post_init__(self) -> None:
        blank = np.where(np.arange(len(STATES)) == BREAK, -1e6, 0.0)  # a break is blank and nothing else is
        self.emit = (blank[:, None, None] + self.kind[:, :, None] + self.place[:, None, :]).reshape(len(STATES), -1).T.tolist()
        self.steps = self.change.T.tolist()

    def label(self, codes: list[int]) -> list[str]:
        """The best path."""
        if not codes:
            return []
        blank = [-1e6, -1e6, 0.0, -1e6]
        best = [a + b for a, b in zip(self.first.tolist(), blank if codes[0] < 0 else self.emit[codes[0]], strict=True)]
        back = []
        for code in codes[1:]:
            came, new = [], []
            for steps, e in zip(self.steps, blank if code < 0 else self.emit[code], strict=True):
                scores = [b + s for b, s in zip(best, steps, strict=True)]
                top = max(scores)
                came.append(scores.index(top))
                new.append(top + e)
            back.append(came)
            best = new
        state = best.index(max(best))
        path = [state]
        for came in reversed(back):
            state = came[state]
            path.append(state)
        return [STATES[s] for s in reversed(path)]


def _guess() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities to begin with."""
    first = np.array([0.45, 0.45, 0.09, 0.01])
    change = np.array([[0.35, 0.55, 0.10, 1e-6], [1e-6, 0.88, 0.07, 0.05], [0.05, 0.80, 0.10, 0.05], [1e-6, 1e-6, 0.10, 0.90]])
    furniture = np.array([[0.01, 0.30, 0.001, 0.001], [0.10, 0.04, 0.02, 0.001], [0.18, 0.20, 0.10, 0.005]]).ravel()
    body = np.array([[0.002, 0.004, 0.12, 0.86], [0.0005, 0.0002, 0.002, 0.01], [0.0002, 0.0001, 0.0003, 0.001]]).ravel()
    kind = np.stack([furniture, body, np.full(KINDS, 1 / KINDS), furniture])
    top, end = np.array([0.60, 0.30, 0.06, 0.03, 0.006, 0.003, 0.001]), np.array([0.001, 0.003, 0.006, 0.03, 0.06, 0.30, 0.60])
    place = np.stack([top, np.array([0.03, 0.04, 0.05, 0.76, 0.05, 0.04, 0.03]), np.full(PLACES, 1 / PLACES), end])
    return tuple(x / x.sum(-1, keepdims=True) for x in (first, change, kind, place))


def fit(pages: list[list[int]], *, rounds: int = ROUNDS, prior: float = PRIOR) -> LineModel:
    """The model fitted to the codes of a sample of pages; without pages it is the first guess."""
    guess = _guess()
    first, change, kind, place = guess
    pages = [p for p in pages if p]
    if pages:
        n = np.array([len(p) for p in pages])
        codes = np.full((len(pages), n.max()), -2)
        for i, p in enumerate(pages):
            codes[i, : len(p)] = p
        there, blank = codes > -2, codes == -1
        kinds, places = np.where(codes >= 0, codes // PLACES, 0), np.where(codes >= 0, codes % PLACES, 0)
        sure_body = (codes >= 0) & ((kinds == NO_NUMBER * 4 + TEXT) | (kinds == NO_NUMBER * 4 + PLAIN))
        sure_furniture = (codes >= 0) & ((kinds == PAGE_NUMBER * 4 + NOTHING) | (kinds == PAGE_NUMBER * 4 + TITLE))
        for _ in range(rounds):
            emit = kind[:, kinds] * place[:, places]
            emit[[HEADER, FOOTER]] *= ~sure_body
            emit[BODY] *= ~sure_furniture
            emit[[HEADER, BODY, FOOTER]] *= ~blank
            emit[BREAK] = blank
            emit = np.moveaxis(np.where(there, emit, 1.0), 0, -1)
            ahead, behind = np.zeros_like(emit), np.ones_like(emit)
            for t in range(codes.shape[1]):
                now = (first if t == 0 else ahead[:, t - 1] @ change) * emit[:, t]
                now = np.where(there[:, t, None], now, ahead[:, t - 1] if t else now)
                ahead[:, t] = now / now.sum(1, keepdims=True)
            moves = np.zeros_like(change)
            for t in range(codes.shape[1] - 2, -1, -1):
                later = behind[:, t + 1] * emit[:, t + 1]
                step = ahead[:, t, :, None] * change * later[:, None, :]
                weight = step.sum((1, 2), keepdims=True)
                moves += (step / weight * there[:, t + 1, None, None]).sum(0)
                now = later @ change.T
                behind[:, t] = np.where(there[:, t + 1, None], now / now.sum(1, keepdims=True), 1.0)
            belief = ahead * behind
            belief = belief / belief.sum(2, keepdims=True) * there[:, :, None]
            seen = belief * (codes >= 0)[:, :, None]
            counted_kind = np.stack([np.bincount(kinds.ravel(), seen[:, :, s].ravel(), KINDS) for s in range(len(STATES))])
            counted_place = np.stack([np.bincount(places.ravel(), seen[:, :, s].ravel(), PLACES) for s in range(len(STATES))])
            counts = (belief[:, 0].sum(0), moves, counted_kind, counted_place)
            first, change, kind, place = ((c + prior * g) / (c + prior * g).sum(-1, keepdims=True) for c, g in zip(counts, guess, strict=True))
    return LineModel(*(np.log(np.maximum(x, 1e-12)) for x in (first, change, kind, place)))
