import random
import zlib

import numpy as np
import pytest

from tidemark.llm import packing, text
from tidemark.llm.queries import tokenizer_path

TEXTS = [
    "It's the dog's, isn't it? WE'LL see; they'd've", "J̌ and ǰ, Å W̊ T̈ İ İ", "<|endoftext|> inside<|startoftext|>x <|ENDOFTEXT|>",
    "tabs\tand\x0bvertical\x0cfeeds\r\n. ,., ...\n\n", "nbsp here line　wide", "漢字とカナ ガ 🎉👩‍👩‍👧 é", "a1b22 3.14,15 x_y-z *** &&&. word.&&& end.", "ÄÖÜ ß ẞ Σς KK", "''' 's 'S a's A'S",
]


def direct(texts, capacity=packing.CAPACITY):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [packing.END_ID] for t in texts]


def test_pieces_equal_the_tokenizer_on_whole_texts(documents, odd):
    rows = [*odd, *((100 + i, t) for i, t in enumerate(TEXTS))]
    want = []
    for (i, _), ids in zip(rows, direct([t for _, t in rows]), strict=True):
        for k, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            want.append((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = [tuple(r) for r in packing.tokenize(documents(rows), tokenizer_path(), capacity=512).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def check_layout(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_exchange_closes_the_gaps_of_partitions(spark):
    rng = random.Random(1)
    rows = [(i, 0, 0, rng.choice([1400, 1300, 1396, 700, 300, 60]), 0) for i in range(600)]
    pieces = spark.createDataFrame(rows, packing.PIECE_SCHEMA)
    least = packing.bound(*np.unique([r[3] for r in rows], return_counts=True), 4096)
    packed = packing.pack(pieces, 4096, per_partition=40).collect()
    assert sorted(r["doc_id"] for r in packed) == list(range(600))
    alone = packing._pack_partitions(pieces, 15, 0, 4096).select("sequence_id").distinct().count()
    used = check_layout(packed, 4096)
    assert least <= used <= least + 4 < alone


def test_whole_query_shape_and_empty_table(documents, odd):
    rows = packing.pack_documents(documents(odd), tokenizer_path()).collect()
    assert check_layout(rows, 4096) == -(-sum(r["length"] for r in rows) // 4096)
    assert packing.pack_documents(documents([]), tokenizer_path()).count() == 0


def exact(lengths, capacity):
    """The fewest bins, by trying all."""
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                bins[k] += lengths[i]
                go(i + 1, bins)
                bins[k] -= lengths[i]
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(30))
def test_bounds_never_exceed_the_optimum(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 17, 100])
    lengths = sorted((rng.randint(1, capacity) for _ in range(9)), reverse=True)
    best = exact(lengths, capacity)
    assert packing.bound(*np.unique(lengths, return_counts=True), capacity) <= best
    assert len(packing.best_fit(np.array(lengths), capacity)[2]) >= best


def test_bound_beats_the_volume():
    assert packing.bound(np.array([51]), np.array([10]), 100) == 10
    assert packing.bound(np.array([34]), np.array([6]), 100) == 3


def test_memo_of_two_generations_gives_the_same_ids(monkeypatch):
    texts = [" ".join(f"w{i * j % 97}, Word{i}." for j in range(60)).encode() for i in range(120)]
    whole = list(packing.WordIds(tokenizer_path()).of(texts))
    monkeypatch.setattr(packing, "_MEMO_BYTES", 4000)
    small = packing.WordIds(tokenizer_path())
    got = [x for lo in range(0, len(texts), 7) for x in small.of(texts[lo : lo + 7])]
    assert got == whole and small.older


def test_other_work_drops_what_packing_kept():
    packing.encoder(tokenizer_path())
    assert text.memo("packing")
    text.memo("quality")
    assert not text.memo("packing")


def test_few_words_are_encoded_at_once_and_the_memo_keeps_to_its_bytes(monkeypatch):
    texts = [" ".join(f"w{i * j % 97}x{i}, Word{i}." for j in range(60)).encode() for i in range(120)]
    whole = list(packing.WordIds(tokenizer_path()).of(texts))
    monkeypatch.setattr(packing, "_ENCODED", 32)
    small, most = packing.WordIds(tokenizer_path(), memo_bytes=50_000), []
    tokenizer = small.tokenizer

    class Counted:
        def encode_batch_fast(self, items, **options):
            most.append(len(items))
            return tokenizer.encode_batch_fast(items, **options)

    small.tokenizer = Counted()
    got, held = [], []
    for lo in range(0, len(texts), 7):
        got += small.of(texts[lo : lo + 7])
        held.append(small.held)
    assert got == whole and max(most) <= 32 and max(held) < 250_000
