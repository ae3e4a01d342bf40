"""Quality classifier over random-indexing word vectors.

Words are runs of small letters, capitals, digits or signs, hashed to one of
``SLOTS`` slots. Every slot has a sparse random index vector; the vector of a
slot is the sum of the index vectors of its neighbours up to ``REACH`` words
away, over the whole corpus. Both tables have a fixed size, which bounds what
tasks send and what is broadcast. A document is the mean of its words' unit
vectors, rare words weighing more, and the logarithm of their number. A
two-layer network learns from labelled documents; a temperature fitted on a part
of them it did not see makes its outputs probabilities.

Learning takes the labelled rows whose crc32(doc_id as text) mod 5 is not 0, at
most ``MOST_ROWS`` of them by hash; all counts and vectors cover all documents.
Labels, language, source and doc_id are no inputs.

Defined results: a null or empty text is the zero vector and gets the score of
that; labels of an id that occurs more than once count as the smallest; rows with
a null doc_id or label are not learned from; without two classes to learn from
every score is 0.5. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .text import KIND_RUNS, batch, binaries, crc_of_ids, hashes, owners, runs, stretches, utf8

SLOTS, SIZE, REACH = 1 << 14, 32, 2
SLICES = 16
MOST_ROWS = 40_000
FOLDS, CALIBRATION_FOLD = 5, 1
HIDDEN, EPOCHS, RATE = 32, 60, 0.01
CUT = 0.3
_SEED = 20240613


def slots_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(rows from, to, slot of each word, document of each)."""
    data, offsets = utf8(column)
    for lo, hi in stretches(offsets):
        piece, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, bounds = runs(piece, own, KIND_RUNS)
        yield lo, hi, (hashes(piece, starts, ends) >> np.uint64(50)).astype(np.int64), owners(bounds)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The place of +1 and of -1 of each slot's index vector."""
    rng = np.random.default_rng(_SEED)
    plus = rng.integers(0, SIZE, SLOTS)
    return plus, (plus + rng.integers(1, SIZE, SLOTS)) % SIZE


def context_sums(docs: DataFrame) -> np.ndarray:
    """Per slot: the sum of its neighbours' index vectors, and its count in the last column."""
    width = SIZE + 1
    schema = pa.schema([("slice", pa.int32()), ("deal", pa.int32()), ("sums", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        plus, minus = index_vectors()
        total = np.zeros(SLOTS * width)
        for rows in batches:
            for _, _, slot, owner in slots_of(rows.column("text")):
                total[SIZE::width] += np.bincount(slot, minlength=SLOTS)
                for step in range(1, REACH + 1):
                    near = owner[step:] == owner[:-step]
                    a, b = slot[:-step][near], slot[step:][near]
                    for x, y in ((a, b), (b, a)):
                        total += np.bincount(x * width + plus[y], minlength=len(total))
                        total -= np.bincount(x * width + minus[y], minlength=len(total))
        if total.any():
            deal = TaskContext.get().partitionId() % 64
            yield batch(schema, slice=range(SLICES), deal=[deal] * SLICES, sums=binaries([x.astype("<f8").tobytes() for x in np.split(total, SLICES)]))

    def add(key, table):
        sums = np.sum([np.frombuffer(x) for x in table.column("sums").to_pylist()], axis=0)
        return pa.table({"slice": [key[0].as_py()], "deal": [0], "sums": [sums.tobytes()]}, schema=schema)

    typed = "slice int, deal int, sums binary"
    parts = docs.mapInArrow(run, typed).groupBy("slice", "deal").applyInArrow(add, typed).groupBy("slice").applyInArrow(add, typed)
    out = np.zeros((SLICES, SLOTS // SLICES * width))
    for r in parts.collect():  # SLICES rows of fixed size
        out[r["slice"]] = np.frombuffer(r["sums"])
    return out.reshape(SLOTS, width)


def word_vectors(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and weights that fall with frequency."""
    vectors, count = sums[:, :SIZE], sums[:, SIZE]
    vectors = vectors - count[:, None] * (vectors.sum(axis=0) / max(count.sum(), 1))
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)
    share = count / max(count.sum(), 1)
    return vectors.astype(np.float32), (1e-3 / (1e-3 + share)).astype(np.float32)


def embeddings(docs: DataFrame, vectors: np.ndarray, weights: np.ndarray) -> DataFrame:
    """(doc_id, crc, features): pooled vectors of all documents."""
    sent = docs.sparkSession.sparkContext.broadcast((vectors * weights[:, None], weights))
    schema = pa.schema([("doc_id", pa.int64()), ("crc", pa.int64()), ("features", pa.binary())])

    def run(batches):
        weighted, weight = sent.value
        for rows in batches:
            out = np.zeros((rows.num_rows, SIZE + 1), np.float32)
            for lo, hi, slot, owner in slots_of(rows.column("text")):
                n = np.bincount(owner, minlength=hi - lo)
                total = np.bincount(owner, weight[slot], hi - lo)
                first = np.flatnonzero(np.diff(owner, prepend=-1)) if len(owner) else owner
                if len(first):
                    out[lo + owner[first], :SIZE] = np.add.reduceat(weighted[slot], first, axis=0)
                out[lo:hi, :SIZE] /= np.maximum(total, 1e-9)[:, None]
                out[lo:hi, SIZE] = np.log1p(n) / 10
            yield batch(schema, doc_id=rows.column("doc_id"), crc=crc_of_ids(rows.column("doc_id")), features=binaries([x.tobytes() for x in out]))

    return docs.mapInArrow(run, "doc_id bigint, crc bigint, features binary")


class Network:
    """Two layers, trained by Adam on the weighted cross-entropy of two classes."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = _SEED):
        rng = np.random.default_rng(seed)
        self.middle, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-6
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.p, self.temperature = p, 1.0
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        z = (x - self.middle) / self.spread
        for _ in range(EPOCHS):
            for at in np.array_split(rng.permutation(len(z)), max(1, len(z) // 256)):
                h = np.tanh(z[at] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[at]) / len(at)
                back = np.outer(d, p[2]) * (1 - h * h)
                t += 1
                for k, g in enumerate((z[at].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.middle) / self.spread @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature of least cross-entropy."""
        z = self.logits(x)
        grid = np.exp(np.linspace(np.log(0.2), np.log(20), 200))
        losses = [np.logaddexp(0, np.where(y > 0, -z, z) / t).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(losses))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def fit(embedded: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Network | None:
    known = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    rows = embedded.where(F.col("crc") % FOLDS != 0).join(known, "doc_id").select("crc", "features", "label")
    rows = rows.orderBy(F.xxhash64("crc", "features"), "label").limit(most_rows).toArrow()
    x = np.frombuffer(b"".join(rows.column("features").to_pylist()), "<f4").reshape(-1, SIZE + 1).astype(float)
    y = rows.column("label").to_numpy().astype(float)
    later = rows.column("crc").to_numpy() % FOLDS == CALIBRATION_FOLD
    if len(set(y[~later].tolist())) < 2:
        return None
    network = Network(x[~later], y[~later])
    if later.any():
        network.calibrate(x[later], y[later])
    return network


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``; ``labels`` has (doc_id, label), 1 for good."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("label").cast("int").alias("label"))
    embedded = materialize(embeddings(docs, *word_vectors(context_sums(docs))))
    network = fit(embedded, labels)

    def run(batches):
        for rows in batches:
            x = np.frombuffer(b"".join(rows.column("features").to_pylist()), "<f4").reshape(-1, SIZE + 1).astype(float)
            score = network.score(x) if network else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(rows.column("crc").to_numpy() % FOLDS == 0), pa.array(score), pa.array((score >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return embedded.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
