"""Byte-level BPE against the reference library, and containers."""

import base64
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lipimala.llm.byte_bpe import VOCABULARY, Encoder, PairTable, encode_texts
from lipimala.llm.packing import best_fit, container_fill, pack, pack_documents

tiktoken = pytest.importorskip("tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def reference():
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    with open(VOCABULARY, "rb") as f:
        return Encoder(f.read())


def test_random_texts(encoder, reference):
    rng = random.Random(7)
    alphabet = " \n\t'srtvemld'A1½ం్క‌\x1c\x85　é😀.-<|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(4000)]
    ids, counts = encoder.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [reference.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("text", ["", "a", "ab" * 3000, "!" * 1500 + " " * 900 + "x", "<|endoftext|>", "క్" * 2000, "it's we'll 's", "x" * 511, "x" * 513])
def test_single_texts(encoder, reference, text):
    assert encoder.encode([text])[0].tolist() == reference.encode_ordinary(text)


def test_forgetting_changes_nothing(encoder, reference):
    encoder.known.update({f"\0{i}": 0 for i in range(1 << 18)})
    assert encoder.encode(["forget me not"])[0].tolist() == reference.encode_ordinary("forget me not")
    assert len(encoder.known) < 100


def test_pair_table_with_crowded_slots():
    rng = np.random.default_rng(0)
    pairs = np.unique(rng.integers(0, 300, (5000, 2)), axis=0)
    table = PairTable(pairs[:, 0], pairs[:, 1], np.arange(len(pairs)))
    assert (table.get(pairs[:, 0], pairs[:, 1]) == np.arange(len(pairs))).all()
    assert (table.get(np.array([-1, 5, 400]), np.array([5, -1, 400])) == 2**31 - 1).all()


def test_rows_with_nulls_and_clashing_columns(spark, reference):
    rows = [(1, "తోతొ text", "x"), (2, None, "x"), (3, "", None), (None, "a", "y")]
    got = {r.doc_id: list(r.ids) for r in encode_texts(spark.createDataFrame(rows, "doc_id bigint, text string, ids string"), "doc_id", "text").collect()}
    assert got == {1: reference.encode_ordinary("తోతొ text"), 2: [], 3: [], None: reference.encode_ordinary("a")}
    assert encode_texts(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0


# --- containers --------------------------------------------------------------------------------------


def _brute(sizes, sources, copies, capacity):
    """Best fit by looking at every bin."""
    keys = [{k for k in (("s", s), ("c", c)) if k[1] is not None} for s, c in zip(sources, copies, strict=True)]

    def run(order, keys, hot, limit):
        bins, out = [], [0] * len(sizes)
        for i in order:
            fit = [b for b in bins if b["room"] >= sizes[i]]
            found = [b for b in fit if not any(b[k] for k in keys[i])]
            if not found and keys[i] & hot and len(bins) >= limit:
                found = [b for b in fit if not any(b[k] for k in keys[i] - hot)]
                worst = lambda b: max(b[k] for k in keys[i] & hot)
                found = [b for b in found if worst(b) == min(map(worst, found))]
            if found:
                best = min(found, key=lambda b: (b["room"], b["no"]))
            else:
                best = Counter(room=capacity, no=len(bins))
                bins.append(best)
            best["room"] -= sizes[i]
            best.update(dict.fromkeys(keys[i], 1))
            out[i] = best["no"]
        return out

    count = Counter(k for own in keys for k in own)
    hot = {k for k, n in count.items() if n > -(-sum(sizes) // capacity)}
    ordered = lambda keys: sorted(range(len(sizes)), key=lambda i: -sizes[i] - capacity * max((count[k] for k in keys[i]), default=0) / len(sizes))
    free = [own - hot for own in keys]
    limit, order = 1 + max(run(ordered(free), free, set(), 0)), ordered(keys)
    hot = {k for k in hot if count[k] > limit}
    room = capacity - min((n for n, own in zip(sizes, keys, strict=True) if own & hot), default=0)
    if hot:
        order.sort(key=lambda i: 0 if sizes[i] > room else 1 if keys[i] & hot else 2)
    return run(order, keys, hot, limit)


def test_best_fit_finds_the_tightest_bin():
    rng = random.Random(4)
    for names in ("aaab", "abcdefghijklmnopqr"):
        for _ in range(60):
            n = rng.randrange(1, 60)
            sizes = [rng.randrange(0, 21) for _ in range(n)]
            sources = [rng.choice(names) if rng.random() < 0.9 else None for _ in range(n)]
            copies = [rng.randrange(8) if rng.random() < 0.6 else None for _ in range(n)]
            assert best_fit(sizes, sources, copies, 20) == _brute(sizes, sources, copies, 20)


def test_a_conflict_opens_a_bin():
    assert len(set(best_fit([60, 50, 40, 30, 20], ["s", "t", "t", "s", "u"], [None] * 5, 100))) == 2
    assert best_fit([10, 10, 90], ["s", "s", None], [None] * 3, 100) == [0, 1, 0]
    assert best_fit([10, 10, 90], [None] * 3, [1, 1, None], 100) == [0, 1, 0]


@pytest.mark.parametrize("size", [4, 60, 200, 330])
@pytest.mark.parametrize("by", ["copies", "sources"])
def test_only_the_surplus_of_a_large_key_shares_bins(size, by):
    rng = random.Random(5)
    sizes = [size if i % 3 == 0 else rng.randrange(1, 600) for i in range(3000)]
    keys, none = [7 if i % 3 == 0 else None for i in range(3000)], [None] * 3000
    bins = best_fit(sizes, *((none, keys) if by == "copies" else (keys, none)), 1000)
    held = Counter(b for b, c in zip(bins, keys, strict=True) if c)
    needed, filled = len(set(best_fit(sizes, none, none, 1000))), Counter()
    for b, n in zip(bins, sizes, strict=True):
        filled[b] += n
    assert max(filled.values()) <= 1000 and len(filled) <= 1.01 * needed
    assert len(held) == needed < 1000 and max(held.values()) == -(-1000 // needed)


def test_pieces_and_capacity(spark):
    rows = [(1, 250, "s", 1), (2, 100, "s", None), (3, 0, None, None), (4, None, None, None), (5, 60, "s", 7), (6, 40, "t", 7), (7, 101, None, None)]
    got = pack(spark.createDataFrame(rows, "id bigint, size int, source string, copy bigint"), "id", "size", "source", "copy", capacity=100).collect()
    fill, pieces = defaultdict(int), defaultdict(list)
    for r in got:
        fill[r.container] += r["size"]
        pieces[r.id].append(r["size"])
    assert max(fill.values()) <= 100
    assert {k: sorted(v) for k, v in pieces.items()} == {1: [50, 100, 100], 2: [100], 3: [0], 4: [0], 5: [60], 6: [40], 7: [1, 100]}


def test_documents(spark):
    rows = [(i, f"word {i} " * 40, "hot" if i % 3 else "s") for i in range(200)]
    rows += rows[:20] + [(900, None, None), (901, "", "s"), (902, "x " * 9000, "s")] + [(1000 + i, "The  same\ntext", "s") for i in range(30)]
    packed = pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).cache()
    assert packed.select("doc_id").distinct().count() == 233 and packed.where("piece = 0").count() == 233
    assert packed.groupBy("container").sum("tokens").where("`sum(tokens)` > 4096").count() == 0
    assert container_fill(packed).first().unused_share < 0.2
    empty = pack_documents(spark.createDataFrame([], "doc_id bigint, text string, source string"))
    assert empty.count() == 0 and container_fill(empty).first().containers == 0
