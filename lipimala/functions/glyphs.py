"""Column functions on font names, character codes, boxes and word sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lipimala.functions.telugu import nfc

# The private-use range of symbol fonts, the private-use plane of shape ids, and the widths
# and distances of the page model.
SYMBOL_BASE, SYMBOL_FIRST, SYMBOL_LAST = 0xF000, 0xF020, 0xF0FF
SHAPE_BASE, SHAPE_LAST = 0xF0000, 0xFFFFD
# The plane above it holds the upper digits of ids too large for one character.
DIGIT_BASE, DIGITS = 0x100000, SHAPE_LAST - SHAPE_BASE + 1
ZERO_WIDTH, BASELINE_TOLERANCE = 0.5, 2.0
# Parts of the names of fonts that are no legacy text fonts.
OTHER_FONTS = ("arial", "times", "courier", "helvetica", "calibri", "cambria", "symbol", "wingdings", "verdana", "georgia", "tahoma", "mangal")


def font_family(name: Column) -> Column:
    """What is between the subset prefix's ``+`` and the first ``,``."""
    return F.substring_index(F.substring_index(name, "+", -1), ",", 1)


def is_candidate_family(family: Column, others: tuple[str, ...] = OTHER_FONTS) -> Column:
    """Whether a family may be a legacy font: its name holds none of ``others``, in any case."""
    return ~F.lower(family).rlike("|".join(others))


def symbol_decode(text: Column, byte_chars: str | None = None) -> Column:
    """Characters of the symbol range as the characters of their bytes.

    ``byte_chars`` has the 224 characters of the bytes 0x20 to 0xFF; without it a byte is its own code.
    """
    codes = range(SYMBOL_FIRST, SYMBOL_LAST + 1)
    to = byte_chars or "".join(chr(c - SYMBOL_BASE) for c in codes)
    return F.translate(text, "".join(map(chr, codes)), to)


class ByteCodec:
    """The characters of a font's bytes: an override where there is one, else what the encoding says.

    ``overrides`` maps bytes to characters. A byte the encoding leaves open has no character.
    """

    def __init__(self, encoding: str = "latin-1", overrides: dict[int, str] | None = None) -> None:
        overrides = overrides or {}
        plain = [bytes([b]).decode(encoding, "ignore") for b in range(256)]
        self.chars = [overrides.get(b) or plain[b] for b in range(256)]
        self._byte = {c: b for b, c in reversed(list(enumerate(plain))) if c} | {c: b for b, c in sorted(overrides.items(), reverse=True)}

    def table(self) -> str:
        """The characters of the bytes 0x20 to 0xFF, for ``symbol_decode``; an open byte gives itself."""
        return "".join(c or chr(b) for b, c in enumerate(self.chars))[0x20:]

    def byte_of(self, char: Column) -> Column:
        """A character's byte, overrides first; null where it has none."""
        known = F.create_map(*(F.lit(x) for pair in self._byte.items() for x in pair))
        return F.element_at(known, char)

    def canonical(self, char: Column) -> Column:
        """The character composed, and as that of its byte where it has one: what an override hides becomes it."""
        changed = {c: self.chars[b] for c, b in self._byte.items() if self.chars[b] != c}
        return F.translate(nfc(char), "".join(changed), "".join(changed.values())) if changed else nfc(char)


def symbol_encode(text: Column, byte_chars: str) -> Column:
    """The inverse of ``symbol_decode``; null where a character is none of the bytes'."""
    to = "".join(chr(SYMBOL_FIRST + i) for i in range(len(byte_chars)))
    known = F.translate(text, byte_chars, "") == ""
    return F.when(known, F.translate(text, byte_chars, to))


def relayout(char: Column, is_type1: Column, layout: dict[str, str]) -> Column:
    """The font's own layout for characters of a Type 1 family; others stay. ``layout`` is a code page."""
    return F.when(is_type1, F.translate(char, "".join(layout), "".join(layout.values()))).otherwise(char) if layout else char


def baseline_box(box: Column, baseline: Column, size: Column, ascent: float, descent: float) -> Column:
    """The box of a legacy glyph: its width as drawn, its height from the font's measures."""
    return F.struct(box["x0"].alias("x0"), (baseline - ascent * size).alias("y0"), box["x1"].alias("x1"), (baseline + descent * size).alias("y1"))


def scaled_box(box: Column, factor: float | Column) -> Column:
    """Pixels to points, or back."""
    return F.struct(*((box[c] * factor).alias(c) for c in ("x0", "y0", "x1", "y1")))


def area(box: Column) -> Column:
    return (box["x1"] - box["x0"]) * (box["y1"] - box["y0"])


def overlap_area(a: Column, b: Column) -> Column:
    wide = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    high = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Shared area by joint area, 0 where the joint area is 0."""
    both = overlap_area(a, b)
    joint = area(a) + area(b) - both
    return F.when(joint > 0, both / joint).otherwise(0.0)


def shape_token(shape_id: Column) -> Column:
    """The character that stands for a shape: the private-use code point U+F0000 plus its id.

    Raises above U+FFFFD, where the plane ends.
    """
    code = F.lit(SHAPE_BASE) + shape_id
    text = F.decode(F.unhex(F.lpad(F.hex(code.cast("bigint")), 8, "0")), "UTF-32")
    return F.when(code > SHAPE_LAST, F.raise_error(F.concat(F.lit("shape id outside the private use plane: "), shape_id.cast("string")))).otherwise(text)


def _character(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("bigint")), 8, "0")), "UTF-32")


def shape_tokens(shape_id: Column) -> Column:
    """The characters that stand for a shape of any id: its ``shape_token``, and before it, from U+100000 on, the
    upper digits of an id that one character can't hold. A first digit 0, which no number has, marks a negative
    id, whose other digits are those of its complement.
    """
    size = F.when(shape_id < 0, F.bitwise_not(shape_id.cast("bigint"))).otherwise(shape_id.cast("bigint"))
    part = lambda i: F.call_function("div", size, F.lit(DIGITS**i).cast("bigint"))
    upper = [F.when(size >= DIGITS**i, _character(DIGIT_BASE + part(i) % DIGITS)).otherwise("") for i in (3, 2, 1)]
    return F.concat(F.when(shape_id < 0, chr(DIGIT_BASE)).otherwise(""), *upper, _character(SHAPE_BASE + size % DIGITS))


def shape_of_token(token: Column) -> Column:
    """The id that ``shape_token`` or ``shape_tokens`` wrote; null for digits that no id has."""
    code = lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("bigint")
    upper = F.transform(characters(F.substring(token, 1, F.length(token) - 1)), lambda c: code(c) - DIGIT_BASE)
    size = F.try_add(F.try_multiply(F.aggregate(upper, F.lit(0).cast("bigint"), lambda n, d: F.try_add(F.try_multiply(n, F.lit(DIGITS).cast("bigint")), d)), F.lit(DIGITS).cast("bigint")), code(F.substring(token, -1, 1)) - SHAPE_BASE)
    return F.when(F.substring(token, 1, 1) == chr(DIGIT_BASE), F.bitwise_not(size)).otherwise(size)


def readable(text: Column) -> Column:
    """Shape characters as ``#id``; other text as it is."""
    plane = "[\\x{100000}-\\x{10FFFD}]{0,4}[\\x{F0000}-\\x{FFFFD}]"
    pieces = F.regexp_extract_all(text, F.lit(f"(?s){plane}|.|\\n"), F.lit(0))
    shown = F.transform(pieces, lambda p: F.when(p.rlike(f"^{plane}$"), F.coalesce(F.concat(F.lit("#"), shape_of_token(p).cast("string")), p)).otherwise(p))
    return F.when(text.rlike(plane), F.array_join(shown, "")).otherwise(text)


def edit_distance(reference: Column, found: Column) -> Column:
    """Edit distance of two arrays of texts with unit costs; an empty side costs the other's length.

    Every distinct text of the two becomes one character, so that the distance of two strings does the work.
    A null text is a text of its own; a null array has no distance.
    """
    plain = lambda words: F.transform(words, lambda w: F.coalesce(w, F.lit("\0")))
    names = F.array_distinct(F.concat(plain(reference), plain(found)))
    code = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(names, w) + 0x10000), 8, "0")), "UTF-32")
    return F.levenshtein(*(F.array_join(F.transform(plain(words), code), "") for words in (reference, found)))


def error_rate(distance: Column, length: Column) -> Column:
    """Errors by reference length, 0 for an empty reference."""
    return F.when(length > 0, distance / length).otherwise(0.0)


def characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
