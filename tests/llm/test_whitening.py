"""The spectral split against a library eigensolver, and whole tables against exact fractions."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, n string, component string, x string"


def table(spark, rows, parts=3):
    df = spark.createDataFrame([(i, v, 0, "n", "c", "x") for i, v in rows], SCHEMA)
    return df.repartition(parts) if rows else df


def spectrum(values, seed=0):
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    a = turn @ np.diag(values) @ turn.T
    return (a + a.T) / 2


@pytest.mark.parametrize(
    "values",
    [[3.0], [2.0, 2.0], [1, 2, 3, 4, 5, 6.0], [1e6] + [1.0] * 20, list(np.geomspace(1e-9, 1, 30)), [5.0] * 7 + [5 + 1e-9] * 3 + [0.0] * 4,
     list(np.random.default_rng(4).random(64)), [0.0] * 5, [-1, 0, 1.0], [1, 1, 1, 0, 0, 0.0]],
)
def test_spectral_split_is_an_eigensolver(values):
    a = spectrum(values)
    got, vectors = whitening.eigen(a)
    size = max(np.linalg.norm(a), 1e-300)
    assert np.all(np.diff(got) <= 1e-12 * size)
    assert np.abs(got - np.sort(np.linalg.eigvalsh(a))[::-1]).max() <= 1e-12 * size
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-12
    assert np.abs(a @ vectors - vectors * got).max() <= 1e-12 * size


def test_diagonal_with_equal_halves():
    got, _ = whitening.eigen(np.diag([4.0, 4.0, 1.0, 1.0, 2.5]))
    assert np.allclose(got, [4, 4, 2.5, 1, 1])


def test_polar_factor_is_orthogonal():
    a = spectrum([1e-12, -1e-7, 1, -3, 0.5])
    u = whitening.polar_factor(a)
    assert np.abs(u @ u - np.eye(5)).max() < 1e-12
    assert np.abs(u @ (u @ a) - a).max() < 1e-12


def exact(rows):
    """(rows that count, n, S, covariance) in fractions."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    mean = [Fraction(v, n) for v in s]
    cov = [[sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fit) / n for j in range(d)] for i in range(d)]
    return kept, n, s, np.array([[float(c) for c in row] for row in cov])


def test_against_exact_fractions(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(j, 0.3 + j / 5) for j in range(6)]) for i in range(150)]
    rows += [(500, rows[3][1])] * 40 + [(None, rows[5][1]), (501, None), (502, [None] * 6), (503, [math.nan] * 6), (504, [math.inf] + [0.0] * 5)]
    got = whitening.whiten(table(spark, rows)).collect()
    kept, n, s, cov = exact(rows)
    assert n == 150 and len(got) == 6 * len(kept)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = sorted((str(i), sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))) for i, x in kept for _ in range(6))
    assert sorted((str(r["vec_id"]), r["deviation"]) for r in got) == want
    by = {(r["vec_id"], r["component"]): r for r in got}
    signs = {}
    for i, x in kept:
        white = (np.array([float(Fraction(a) - Fraction(b, n)) for a, b in zip(x, s, strict=True)]) @ vectors) / np.sqrt(values)
        for k in range(6):
            r = by[i, k + 1]
            sign = signs.setdefault(k, 1 if r["whitened"] * white[k] > 0 else -1)
            assert abs(r["whitened"] - sign * white[k]) < 1e-9
            assert abs(r["explained"] / (values[k] / values.sum()) - 1) < 1e-9
            assert r["n"] == n and r["identity_error"] < 1e-9


def test_large_entries_stay_exact(spark):
    rng = random.Random(1)
    rows = [(i, [float(rng.randrange(-(1 << 21), 1 << 21)) for _ in range(3)]) for i in range(400)]
    got = whitening.whiten(table(spark, rows)).collect()
    kept, n, s, _ = exact(rows)
    want = {i: sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)) for i, x in kept}
    assert all(r["deviation"] == (want[r["vec_id"]] if want[r["vec_id"]] < 1 << 63 else None) for r in got)
    assert got[0]["identity_error"] < 1e-9


def test_at_most_sixteen_components_and_no_variance(spark):
    rng = random.Random(9)
    wide = [(i, [rng.random() for _ in range(20)]) for i in range(60)]
    got = whitening.whiten(table(spark, wide)).collect()
    assert sorted({r["component"] for r in got}) == list(range(1, 17)) and len(got) == 16 * 60
    flat = [(i, [float(i), 2.0, float(2 * i)]) for i in range(30)]
    assert {r["component"] for r in whitening.whiten(table(spark, flat)).collect()} == {1}
    assert whitening.whiten(table(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).count() == 0
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None)])).count() == 0


def test_unequal_widths_are_refused(spark):
    with pytest.raises(ValueError):
        whitening.whiten(table(spark, [(1, [1.0]), (2, [1.0, 2.0])]))
