"""Encoding of a whole corpus by a public byte-level BPE vocabulary.

A batch of texts becomes one array of code points. Character classes give all pre-token borders at once, two
polynomial hashes give every pre-token an identity that is then compared character by character, and each
distinct pre-token is merged once. Merging works on padded matrices of pre-tokens of like length: every row
merges its leftmost pair of least rank each round, pairs are looked up in a hash table, and rows that have
no pair left are taken out of the matrix.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lipimala.runtime import pick

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters encoded at once, pre-tokens remembered between batches, and the length in bytes from which a
#: pre-token is merged by a heap instead of a matrix row (a matrix needs time in the square of its width).
CHUNK, REMEMBER, LONG = 1 << 20, 1 << 18, 512

# The characters with the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The contractions the pattern takes off first.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
_NONE = np.int32(2**31 - 1)
_MUL = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _classes() -> np.ndarray:
    """Letter, number, white space or other for every code point."""
    kinds = np.zeros(sys.maxunicode + 1, np.uint8)
    first = np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)).encode(), "S1")
    kinds[first == b"L"], kinds[first == b"N"] = _LETTER, _NUMBER
    kinds[WHITE_SPACE] = _SPACE
    return kinds


class PairTable:
    """Open-addressing hash table from a pair of ids to the id (which is the rank) of their merge."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        bits = max(4, int(4 * len(left)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32)
        keys = (left.astype(np.int64) << 32) | right
        slots, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            at = slots[todo]
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[todo[free]]  # of several keys for a slot the last stays
            won = free & (self.keys[at] == keys[todo])
            self.values[at[won]] = merged[todo[won]]
            todo = todo[~won]
            slots[todo] = (slots[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MUL[0]) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids; ``_NONE`` where the pair is in no merge (padding is -1 and is in none)."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], _NONE)
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            slots[todo] = (slots[todo] + 1) & self.mask
            found = self.keys[slots[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slots[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out


class Vocabulary:
    """The ids of a file of lines "base64 token, rank"."""

    def __init__(self, lines: bytes) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(a, b, r) for token, r in ranks.items() for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None]
        self.pairs = PairTable(*np.array(pairs, np.int64).T) if pairs else PairTable(*np.zeros((3, 0), np.int64))
        self.lookup = {(a, b): r for a, b, r in pairs}

    def merge_matrix(self, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Encodes the rows of a matrix padded with -1 at the right: (row numbers, finished rows) by finish."""
        rows, done = np.arange(len(ids)), []
        ranks = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(rows):
            if not ranks.shape[1]:
                done.append((rows, ids))
                break
            at = ranks.argmin(axis=1)  # the leftmost of equal ranks
            least = np.take_along_axis(ranks, at[:, None], 1)[:, 0]
            over = least == _NONE
            if over.any():  # compaction: finished rows leave
                done.append((rows[over], ids[over]))
                keep = ~over
                rows, ids, ranks, at, least = rows[keep], ids[keep], ranks[keep], at[keep], least[keep]
                if not len(rows):
                    break
            each = np.arange(len(rows))
            width = ids.shape[1] - 1
            columns = np.arange(width)[None]
            after = columns > at[:, None]
            ids = np.where(after, ids[:, 1:], ids[:, :-1])  # the merged pair's right half is shifted out
            ids[each, at] = least
            ranks = np.where(after[:, : width - 1], ranks[:, 1:], ranks[:, :-1]) if width > 1 else ranks[:, :0]
            if width > 1:
                left, right = np.flatnonzero(at > 0), np.flatnonzero(at < width - 1)
                ranks[left, at[left] - 1] = self.pairs.get(ids[left, at[left] - 1], ids[left, at[left]])
                ranks[right, at[right]] = self.pairs.get(ids[right, at[right]], ids[right, at[right] + 1])
        return done

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same for one very long row, by a heap: n log n steps whatever the length."""
        n = len(ids)
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.lookup.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = rank, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] >= 0 and (r := self.lookup.get((ids[x], ids[after[x]]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[after[x]]))
        return [x for x, live in zip(ids, alive, strict=True) if live]


class Encoder:
    """Encodes batches of texts; remembers the pre-tokens it has merged."""

    def __init__(self, lines: bytes) -> None:
        self.vocabulary, self.kinds = Vocabulary(lines), _classes()
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def borders(self, chars: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin, for the pattern of the public vocabulary, in all texts at once."""
        kind, n = self.kinds[chars], len(chars)
        first = np.zeros(n + 1, bool)
        first[text_starts] = True
        begins = first[:n].copy()
        begins[1:] |= kind[1:] != kind[:-1]
        run = np.flatnonzero(begins)
        end = np.r_[run[1:], n]
        space = kind[run] == _SPACE
        before = space & (end < n) & ~first[end]  # a run of blanks with more text after it gives up its last one
        last = end[before] - 1
        begins[last] = True
        joined = chars[last] == 0x20  # a plain blank goes to what follows
        begins[end[before][joined]] = False
        quote = np.flatnonzero((chars == 0x27) & begins)  # after a joined blank a quote begins nothing
        if len(quote):
            padded = np.r_[chars, np.zeros(3, chars.dtype)]
            same = np.r_[first, np.ones(3, bool)]
            for mark in CONTRACTIONS:
                fits = np.ones(len(quote), bool)
                for k, c in enumerate(mark):
                    fits &= padded[quote + k] == ord(c)
                    if k:
                        fits &= ~same[quote + k]
                hit = quote[fits]
                begins[hit + 1] = False
                stop = hit + len(mark)
                begins[stop[stop < n]] = True
        return np.flatnonzero(begins)

    def _learn(self, tokens: list[str]) -> None:
        """Merges pre-tokens not met before."""
        raw = [t.encode() for t in tokens]
        sizes = np.array([len(x) for x in raw])
        out: list = [None] * len(raw)
        byte_ids = self.vocabulary.byte_ids
        for i in np.flatnonzero(sizes > LONG):
            out[i] = np.array(self.vocabulary.merge_long(byte_ids[np.frombuffer(raw[i], np.uint8)].tolist()), np.int32)
        short = np.flatnonzero(sizes <= LONG)
        order = short[np.argsort(sizes[short], kind="stable")]
        edges = [0, *(int(np.searchsorted(sizes[order], w, "right")) for w in (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256, LONG))]
        for lo, hi in zip(edges, edges[1:], strict=False):  # buckets of like length
            for part in np.array_split(order[lo:hi], max(1, (hi - lo) // 20_000)):
                if not len(part):
                    continue
                lengths = sizes[part]
                matrix = np.full((len(part), lengths.max()), -1, np.int32)
                matrix[np.arange(lengths.max())[None] < lengths[:, None]] = byte_ids[np.frombuffer(b"".join(raw[i] for i in part), np.uint8)]
                for rows, ids in self.vocabulary.merge_matrix(matrix):
                    for r, row in zip(rows, ids, strict=True):
                        out[part[r]] = row[row >= 0]
        at = len(self.lengths)
        self.known.update(zip(tokens, range(at, at + len(tokens)), strict=True))
        lengths = np.array([len(x) for x in out], np.int32)
        self.lengths = np.r_[self.lengths, lengths]
        self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(lengths) - lengths]
        self.flat = np.concatenate([self.flat, *out])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        sizes = np.array([len(t) for t in texts], np.int64)
        whole = "".join(texts)
        if not whole:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        chars = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        text_starts = np.cumsum(sizes) - sizes
        starts = self.borders(chars, text_starts[sizes > 0])
        lengths = np.diff(np.r_[starts, len(chars)])
        which = self._which(whole, chars, starts, lengths)
        counts = self.lengths[which].astype(np.int64)
        ends = np.cumsum(counts)
        ids = self.flat[np.repeat(self.starts[which] - (ends - counts), counts) + np.arange(ends[-1])]
        # ids before each text: those of the pre-tokens that begin before it
        upto = np.r_[0, ends][np.searchsorted(starts, np.r_[text_starts, len(chars)])]
        return ids, np.diff(upto)

    def _which(self, whole: str, chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The number of every pre-token in ``known``; merges those that are new."""
        if len(self.known) > REMEMBER:
            self.known.clear()
            self.flat, self.starts, self.lengths = self.flat[:0], self.starts[:0], self.lengths[:0]
        # up to three characters fit into one number exactly; longer ones are told apart by hash, then compared
        wide = np.r_[chars, np.zeros(3, np.uint32)].astype(np.uint64)
        key = wide[starts].copy()
        for k in (1, 2):
            more = lengths > k
            key[more] |= wide[starts[more] + k] << np.uint64(21 * k)
        long = np.flatnonzero(lengths > 3)
        if len(long):
            mixed = (chars.astype(np.uint64) + np.uint64(1)) * _MUL[1]
            mixed ^= mixed >> np.uint64(29)
            at = np.repeat(starts[long], lengths[long])
            sizes = lengths[long]
            ends = np.cumsum(sizes)
            inside = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
            weight = (inside.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _MUL[0]
            weight ^= weight >> np.uint64(31)
            value = mixed[at + inside] * weight
            value ^= value >> np.uint64(33)
            sums = np.add.reduceat(value * _MUL[1], ends - sizes)
            key[long] = sums | np.uint64(1 << 63)
        _, index, inverse = np.unique(key, return_index=True, return_inverse=True)
        if len(long):
            index, inverse = self._certain(chars, starts, lengths, long, index, inverse)
        tokens = [whole[starts[i] : starts[i] + lengths[i]] for i in index]
        new = [t for t in tokens if t not in self.known]
        if new:
            self._learn(list(dict.fromkeys(new)))
        return np.fromiter((self.known[t] for t in tokens), np.int64, len(tokens))[inverse]

    @staticmethod
    def _certain(chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray, long: np.ndarray, index: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gives pre-tokens that share a hash without being equal a number of their own."""
        like = index[inverse[long]]
        wrong = lengths[long] != lengths[like]
        sizes = np.where(wrong, 0, lengths[long])
        ends = np.cumsum(sizes)
        if ends[-1]:
            inside = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
            differs = chars[np.repeat(starts[long], sizes) + inside] != chars[np.repeat(starts[like], sizes) + inside]
            wrong |= np.bincount(np.repeat(np.arange(len(long)), sizes), weights=differs, minlength=len(long)) > 0
        if wrong.any():
            own = long[wrong]
            inverse = inverse.copy()
            inverse[own] = len(index) + np.arange(len(own))
            index = np.r_[index, own]
        return index, inverse


_ENCODERS: dict[bytes, Encoder] = {}


def _encoder(lines: bytes) -> Encoder:
    """The worker process's encoder: what it has merged serves the next task too."""
    key = hashlib.sha256(lines).digest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(lines)
    return _ENCODERS[key]


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of whole rows with about ``CHUNK`` characters; a longer text is a slice of its own."""
    for batch in batches:
        texts = [t or "" for t in batch.column(column).to_pylist()]
        begin, size = 0, 0
        for i, t in enumerate(texts):
            if size and size + len(t) > CHUNK:
                yield batch.slice(begin, i - begin), texts[begin:i]
                begin, size = i, 0
            size += len(t)
        if begin < len(texts):
            yield batch.slice(begin), texts[begin:]


def _vocabulary_lines(spark, path: str):
    """The file's bytes as a broadcast: executors need not have the file. Its size is that of a vocabulary."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_texts(documents: DataFrame, ident: str, text: str, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """(``ident``, ids array<int>) of every row; null and empty texts give the empty list.

    No special token is ever made: their strings are ordinary text. No shuffle; rows stay where they are.
    """
    lines = _vocabulary_lines(documents.sparkSession, vocabulary)
    rows = pick(documents, ident, text).toDF("ident", "text")
    kind = rows.schema["ident"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(lines.value)
        for batch, texts in _chunks(batches, 1):
            ids, counts = encoder.encode(texts)
            offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))], names=["ident", "ids"])

    return rows.mapInArrow(run, f"ident {kind}, ids array<int>").withColumnRenamed("ident", ident)


def count_tokens(documents: DataFrame, text: str, name: str = "tokens", *, vocabulary: str = VOCABULARY) -> DataFrame:
    """All columns but ``text`` and the number of its ids, as int; 0 for null and empty texts."""
    lines = _vocabulary_lines(documents.sparkSession, vocabulary)
    kept = [c for c in documents.columns if c != text]
    rows = pick(documents, *kept, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(lines.value)
        for batch, texts in _chunks(batches, len(kept)):
            counts = encoder.encode(texts)[1].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts)], names=[*kept, name])

    return rows.mapInArrow(run, f"{schema}{', ' if schema else ''}`{name}` int")
