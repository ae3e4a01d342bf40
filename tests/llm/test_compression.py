"""Product codes against a full scan of every entry in every round, with Python's whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tidemark.llm import compression

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, error string, state string, x string"


def brute(rows, entries=256, rounds=4):
    """{(vec_id, vector): (code, error)} and the codebooks, from the definition."""
    kept = [(i, [math.floor(1024 * c) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 4
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [[min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e)) for p in range(4)] for _, v, _ in kept]

    for _ in range(rounds):
        codes = assign()
        new = []
        for p in range(4):
            own = [[cut(v, p) for (_, v, _), c in zip(kept, codes, strict=True) if c[p] == e] for e in range(len(books[p]))]
            new.append([[sum(col) // len(m) for col in zip(*m, strict=True)] if m else books[p][e] for e, m in enumerate(own)])
        books = new
    codes = assign()
    out = [(i, "".join(f"{x:02x}" for x in c), sum(far(cut(v, p), books[p][c[p]]) for p in range(4)), label) for (i, v, label), c in zip(kept, codes, strict=True)]
    by_label = {}
    for _, _, e, label in out:
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted((str(i), c, e, by_label[label], digest) for i, c, e, label in out)


def table(spark, rows, parts=3):
    full = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], label, "c", "e", "s", "x") for i, v, label in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.repartition(parts) if full else df


def got(df):
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


def rounded(rows):
    return [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], label) for i, v, label in rows]


def clusters(rng, n, width=16):
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(12)]
    return [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)], rng.choice([None, 0, 1, 2])) for i in range(n)]


def test_equals_a_full_scan_and_measures_less(spark):
    rows = clusters(random.Random(3), 700)
    df = table(spark, rows)
    assert got(compression.compress(df)) == brute(rounded(rows))
    scanned = compression.train(df)[0].agg({"scanned": "sum"}).first()[0]
    assert scanned < 0.75 * 5 * 4 * 256 * len(rows)


def test_odd_rows_ties_and_repeats(spark):
    rng = random.Random(8)
    rows = clusters(rng, 60, 8)
    rows += [(900, None, 1), (901, [None] * 8, 1), (902, [math.nan] + [0.0] * 7, 2), (903, [math.inf] + [0.0] * 7, 2), (904, [-math.inf] + [0.0] * 7, None)]
    rows += [(905, [0.5] * 8, 1)] * 40 + [(None, [0.25] * 8, None), (None, [0.25] * 8, None)]
    # Small whole numbers give many equal distances.
    rows += [(1000 + i, [rng.choice([-1, 0, 1]) / 1024 for _ in range(8)], 3) for i in range(300)]
    assert got(compression.compress(table(spark, rows))) == brute(rounded(rows))


def test_components_beyond_exact_doubles(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-2e5, 2e5) for _ in range(4)], i % 3) for i in range(90)]
    assert got(compression.compress(table(spark, rows))) == brute(rounded(rows))


def test_one_row_and_none(spark):
    assert got(compression.compress(table(spark, [(7, [0.1, -0.1, 3.0, 0.0], None)]))) == brute(rounded([(7, [0.1, -0.1, 3.0, 0.0], None)]))
    assert compression.compress(table(spark, [])).count() == 0
    assert compression.compress(table(spark, [(1, None, 1)])).count() == 0


def test_unequal_widths_are_refused(spark):
    with pytest.raises(ValueError):
        compression.compress(table(spark, [(1, [1.0] * 4, 0), (2, [1.0] * 8, 0)]))
    with pytest.raises(ValueError):
        compression.compress(table(spark, [(1, [1.0] * 6, 0)]))
    with pytest.raises(ValueError):
        compression.compress(table(spark, [(1, [3e9] * 4, 0)]))


@pytest.mark.parametrize("seed", range(4))
def test_bounds_hold_and_are_tighter_than_summed_drifts(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-200, 200, (400, 8))
    books = compression.Codebooks(x[:64].reshape(64, 2, 4).swapaxes(0, 1).copy(), 8)
    state = np.zeros(len(x), compression.layout(2, 8))
    books.assign(x, state, True, True)
    drift = np.zeros((2, 8))
    for _ in range(5):
        new = books.history[-1].copy()
        for p in range(2):
            for e in range(64):
                own = state["code"][:, p] == e
                if own.any():
                    new[p, e] = x[own, p * 4 : p * 4 + 4].sum(axis=0) // own.sum()
        step = np.sqrt(((new - books.history[-1]) ** 2).sum(axis=2))
        books.add(new)
        drift += [[step[p, m].max() if len(m) else 0 for m in books.members[p]] for p in range(2)]
        assert (books.moved[0] <= drift * (1 + 1e-6) + 1e-6).all()
        books.assign(x, state, False, True)
        for p in range(2):
            far = np.sqrt(((x[:, None, p * 4 : p * 4 + 4] - new[p]) ** 2).sum(axis=2))
            assert (state["code"][:, p] == far.argmin(axis=1)).all()
            for g, members in enumerate(books.members[p]):
                true = np.where(members == state["code"][:, p][:, None], np.inf, far[:, members]).min(axis=1)
                now = state["lower"][:, p, g] - books.moved[state["stamp"][:, p, g], p, g]
                assert (now <= true).all()
