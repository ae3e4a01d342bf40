"""Toxicity by cumulative-link ordinal regression.

Features are the distinct words of a text (runs of letters, small) and their
first four and six bytes, hashed to ``DIMENSIONS`` places. One weight vector is
shared by all thresholds, none below 0, so that words can only add severity:

    P(grade <= k) = 1 / (1 + exp(s - t_k)),   s = sum of the weights of a text's features

and the severity is the expected grade. An L1 penalty leaves few weights, which
are broadcast; their number is bounded by ``DIMENSIONS``.

Where labels are only 0 and 1, toxic rows are graded 1..``GRADES`` by quantiles of
the number of marked words they have, i.e. of different words that come at least
``MARKED`` times as often in toxic rows as in others, among the rows learned from.

Learning takes at most ``MOST_ROWS`` labelled rows of each label, by hash, from
those whose crc32(doc_id as text) mod 5 is not 0.

Defined results: a null or empty text has no features and gets the severity of
that; of several labels of one id the largest counts; rows with a null doc_id or
label are not learned from; with labels of one kind only, no text is toxic and
the severity is 0. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..joins import bounded_broadcast
from .text import LETTER_RUNS, batch, hashes, lowered, owners, runs, stretches, utf8

DIMENSIONS = 1 << 20
PREFIXES = (4, 6)
GRADES = 3
MARKED = 20.0
MOST_ROWS = 5000
FOLDS = 5
LEAST_ROWS, L1, STEPS, RATE = 4, 3e-4, 300, 0.3


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(rows from, to, feature places of each word as columns: the word first, document of each word)."""
    data, offsets = utf8(column)
    for lo, hi in stretches(offsets):
        piece, own = lowered(data[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo]
        starts, ends, bounds = runs(piece, own, LETTER_RUNS)
        places = [hashes(piece, starts, ends)]
        for n in PREFIXES:
            cut = hashes(piece, starts, np.minimum(starts + n, ends))
            places.append(np.where(ends - starts > n, cut ^ np.uint64(n << 32), places[0]))
        yield lo, hi, np.stack([(x % np.uint64(DIMENSIONS)).astype(np.int64) for x in places], axis=1), owners(bounds)


def sample(docs: DataFrame, labels: DataFrame, most_rows: int) -> list[tuple[np.ndarray, int]]:
    """(word feature places, label) of the rows to learn from, in a fixed order."""
    known = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0)
    mark = F.xxhash64("doc_id")
    picked = [known.where(F.col("label") > 0).orderBy(mark, "doc_id").limit(most_rows), known.where(F.col("label") <= 0).orderBy(mark, "doc_id").limit(most_rows)]
    rows = docs.join(bounded_broadcast(picked[0].union(picked[1])), "doc_id")

    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("places", pa.list_(pa.int32()))])

    def run(batches):
        for rows in batches:
            ids, label = rows.column("doc_id").to_pylist(), rows.column("label").to_pylist()
            for lo, hi, places, owner in features(rows.column("text")):
                at = np.searchsorted(owner, np.arange(hi - lo + 1))
                found = [np.unique(places[a:b], axis=0).astype(np.int32).ravel() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield batch(schema, doc_id=ids[lo:hi], label=label[lo:hi], places=pa.array(found, pa.list_(pa.int32())))

    got = rows.select("doc_id", F.col("label").cast("int"), "text").mapInArrow(run, "doc_id bigint, label int, places array<int>").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    return [(np.asarray(x.values).reshape(-1, 1 + len(PREFIXES)), y) for x, y in zip(got.column("places"), got.column("label").to_pylist(), strict=True)]


def graded(rows: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Grades 0..GRADES of rows with labels 0 and 1; labels above 1 are grades already."""
    y = np.array([n for _, n in rows])
    if not len(y) or y.max() > 1 or not y.any():
        return np.maximum(y, 0)
    counts = np.ones((2, DIMENSIONS))
    for places, n in rows:
        counts[n, np.unique(places[:, 0])] += 1
    ratio = counts[1] / y.sum() / (counts[0] / max(1, (1 - y).sum()))
    marked = (ratio >= MARKED) & (counts[1] > 3)
    found = np.array([int(marked[p[:, 0]].sum()) for p, _ in rows])
    edges = np.quantile(found[y == 1], np.arange(1, GRADES) / GRADES, method="lower")
    return np.where(y == 1, 1 + np.searchsorted(edges, found, "left"), 0)


class Ordinal:
    """Cumulative-link model: places with weights, the weights, and rising thresholds."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray):
        each = [np.unique(x) for x in rows]
        used, flat, held = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(rows)), [len(x) for x in each])
        common = held >= LEAST_ROWS
        row, flat = row[common[flat]], (np.cumsum(common) - 1)[flat[common[flat]]]
        used, top, n = used[common], int(y.max()), len(y)
        weight = np.full(n, 1 / n)
        w, t, penalty, free = np.zeros(len(used)), np.linspace(0.5, 2.5, top), L1, np.ones(len(used), bool)
        # First the penalty picks the features, then those are fitted with next to none.
        for turn in range(2):
            grown_w, grown_t = np.full(len(used), 1e-8), np.full(top, 1e-8)
            for _ in range(STEPS):
                s = np.bincount(row, w[flat], n)
                above = np.where(y < top, _sigmoid(t[np.minimum(y, top - 1)] - s), 1.0)
                below = np.where(y > 0, _sigmoid(t[np.maximum(y - 1, 0)] - s), 0.0)
                p = np.maximum(above - below, 1e-12)
                g = np.bincount(flat, (weight * (1 - above - below))[row], len(used))
                up = np.bincount(np.minimum(y, top - 1), np.where(y < top, -weight * above * (1 - above) / p, 0), top)
                up += np.bincount(np.maximum(y - 1, 0), np.where(y > 0, weight * below * (1 - below) / p, 0), top)
                grown_w += g * g
                grown_t += up * up
                step = RATE / np.sqrt(grown_w)
                w = np.where(free, w - step * g, 0.0)
                w = np.maximum(w - step * penalty, 0)
                t = np.maximum.accumulate(np.sort(t - RATE / np.sqrt(grown_t) * up) + 1e-6 * np.arange(top))
            free, penalty = w != 0, L1 / 50
        kept = w != 0
        self.places, self.weights, self.thresholds = used[kept], w[kept], t

    def above(self, s: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold, a column each."""
        return _sigmoid(s[:, None] - self.thresholds)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def grade(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """(doc_id, severity, grade, p_toxic, toxic) per row of ``docs``; ``labels`` has (doc_id, label).

    ``severity`` is the expected grade, ``grade`` the likeliest; a text is toxic
    if a grade above 0 is likelier than not.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("label").cast("int").alias("label"))
    rows = sample(docs, labels, most_rows)
    y = graded(rows)
    model = Ordinal([x for x, _ in rows], y) if len(set(y.tolist())) > 1 else None
    sent = docs.sparkSession.sparkContext.broadcast((model.places, model.weights) if model else None)
    thresholds = model.thresholds if model else None
    schema = pa.schema([("doc_id", pa.int64()), ("severity", pa.float64()), ("grade", pa.int32()), ("p_toxic", pa.float64()), ("toxic", pa.bool_())])

    def run(batches):
        weight = np.zeros(DIMENSIONS)
        if sent.value:
            weight[sent.value[0]] = sent.value[1]
        for rows in batches:
            s = np.zeros(rows.num_rows)
            for lo, hi, places, owner in features(rows.column("text")):
                flat, whose = places.ravel(), np.repeat(owner, places.shape[1])
                at = np.flatnonzero(weight[flat])
                once = np.unique(whose[at] * DIMENSIONS + flat[at])
                s[lo:hi] = np.bincount(once // DIMENSIONS, weight[once % DIMENSIONS], hi - lo)
            above = _sigmoid(s[:, None] - thresholds) if thresholds is not None else np.zeros((len(s), 1))
            each = np.diff(np.column_stack([np.ones(len(s)), above, np.zeros(len(s))]), axis=1) * -1
            yield batch(schema, doc_id=rows.column("doc_id"), severity=above.sum(axis=1), grade=each.argmax(axis=1).astype(np.int32), p_toxic=above[:, 0], toxic=above[:, 0] >= 0.5)

    return docs.mapInArrow(run, "doc_id bigint, severity double, grade int, p_toxic double, toxic boolean")
