import hashlib
import zlib

from tidemark.llm import chunking


def brute(rows):
    """The contract row by row, next documents by a sorted list."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), zlib.crc32(x[1].encode())))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        own, new, following = (chunking.chunks(x.encode()) for x in (t, changed, after))
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), chunking.written(own), chunking.written(new), chunking.likeness(own, new), chunking.likeness(own, following)))
    return sorted(out, key=str)


def test_rows_equal_brute_force(documents, odd):
    rows = odd + [(1000 + 7 * i, f"text {i} " * (i % 50) + "tail") for i in range(700)] + [(2**60, "far away"), (-5, "negative")]
    got = sorted(map(tuple, chunking.fingerprints(documents(rows, parts=5)).collect()), key=str)
    assert got == brute(rows)


def test_empty_and_single(documents):
    assert chunking.fingerprints(documents([])).count() == 0
    (row,) = chunking.fingerprints(documents([(3, "only one")])).collect()
    assert row["near_next"] == 1.0 and row["n_chars"] == 8
    assert chunking.fingerprints(documents([(None, "a"), (None, "b"), (None, None)])).count() == 3


def test_cuts_cover_the_text_and_survive_a_shift():
    import numpy as np

    rng = np.random.default_rng(1)
    text = rng.integers(97, 123, 3_000_000, dtype=np.uint8).tobytes()
    ends = chunking.cuts(np.frombuffer(text, np.uint8))
    lengths = np.diff([0, *ends])
    assert ends[-1] == len(text) and lengths[:-1].min() >= chunking.LEAST and lengths.max() <= chunking.MOST
    assert chunking.likeness(chunking.chunks(text[:20_000]), chunking.chunks(b"inserted " + text[:20_000])) > 0.97


def test_least_and_greatest_ids(documents):
    ids = [-(2**63), 2**63 - 1, 0, None]
    rows = [(i, f"text of {i} " * 50) for i in ids]
    got = {r["doc_id"]: r for r in chunking.fingerprints(documents(rows)).collect()}
    assert set(got) == set(ids) and all(got[i]["n_chars"] == len(t) for i, t in rows)
