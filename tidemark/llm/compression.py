"""Product codes for vectors, trained with norm-of-sum bounds.

Every vector is cut into consecutive parts; each part position has a codebook
that a few rounds of k-means improve. All distances are exact whole numbers.

Rescans are avoided by lower bounds. The entries of a codebook are in groups,
and a row keeps, per part and group, a bound of its distance to the nearest
entry it is not assigned to, with the round in which the bound was measured.
The codebooks of all rounds are kept. At a later round, an entry is as far from
where it was at the stamp as its *net* displacement says (the norm of the sum of
its drifts), which is at most the sum of the norms, so

    bound now = bound at the stamp - largest net displacement in the group since.

A group is rescanned exactly only if this is not above the exact distance to the
present entry. Equal distances never pass the test, so ties go to the lower
index as in a full scan.

Rows stay in their partitions: a round is one pass over the state table, one sum
per (part, entry) and task, and 4 x 256 rows to the driver.

Defined results: rows whose vector is null or has null or non-finite components
are dropped. Equal rows are coded one by one; a null ``vec_id`` sorts last among
the first entries, and rows of one ``vec_id`` sort by components. A table of
fewer than 256 rows has as many entries as rows. A null label is a group of its
own. Extra columns are ignored. An empty table gives no rows. Vectors of
different widths, or of a width the parts do not divide, are refused, as are
components so large that a squared distance might exceed 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..joins import lookup
from ..session import materialize
from .vectors import matrix, measure, whole

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
GROUPS = 16
#: Rounding of square roots and of bounds kept in 32 bits stays below this share.
SLACK = 1e-9

_STATE = "vec_id bigint, label {label}, x array<bigint>, state binary, error bigint, scanned bigint"


def layout(parts: int, groups: int) -> np.dtype:
    """One row's state: its codes, and a bound with its stamp per part and group."""
    return np.dtype([("code", "u1", (parts,)), ("lower", "<f4", (parts, groups)), ("stamp", "u1", (parts, groups))])


def grouped(book: np.ndarray, groups: int) -> np.ndarray:
    """Group of each entry of a codebook, near entries together."""
    points = book.astype(float)
    centres = points[:1]
    while len(centres) < groups:
        far = ((points[:, None] - centres) ** 2).sum(axis=2).min(axis=1)
        centres = np.vstack([centres, points[far.argmax()]])
    for _ in range(8):
        group = ((points[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.stack([points[group == g].mean(axis=0) if (group == g).any() else centres[g] for g in range(groups)])
    return group


def squared(x: np.ndarray, entries: np.ndarray, exact_in_float: bool) -> np.ndarray:
    """Squared distances (rows, entries) as int64; through matrix products where doubles hold every sum exactly."""
    if exact_in_float:
        a, b = x.astype(float), entries.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    out = np.empty((len(x), len(entries)), np.int64)
    for j, entry in enumerate(entries):
        out[:, j] = ((x - entry) ** 2).sum(axis=1)
    return out


class Codebooks:
    """The codebooks of all rounds so far, as tasks need them: (round, part, entry, component)."""

    def __init__(self, first: np.ndarray, groups: int = GROUPS):
        self.history = first[None]
        self.groups = min(groups, first.shape[1])
        self.group = np.stack([grouped(book, self.groups) for book in first])
        self.members = [[np.flatnonzero(own == g) for g in range(self.groups)] for own in self.group]
        self.moved = np.zeros((1, *self.group.shape[:1], self.groups))

    def add(self, books: np.ndarray) -> None:
        self.history = np.concatenate([self.history, books[None]])
        net = np.sqrt(((books[None] - self.history).astype(float) ** 2).sum(axis=3)) * (1 + SLACK)
        self.moved = np.stack(
            [[[net[r, p, m].max(initial=0) for m in members] for p, members in enumerate(self.members)] for r in range(len(net))]
        )

    def assign(self, x: np.ndarray, state: np.ndarray, fresh: bool, exact_in_float: bool) -> tuple[np.ndarray, np.ndarray]:
        """Brings ``state`` to the newest codebooks; returns each row's error and the distances measured for it."""
        now, books = len(self.history) - 1, self.history[-1]
        n, parts = len(x), len(books)
        error, scanned = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for p, (piece, book) in enumerate(zip(np.split(x, parts, axis=1), books, strict=True)):
            code, lower, stamp = state["code"][:, p], state["lower"][:, p], state["stamp"][:, p]
            own = ((piece - book[code]) ** 2).sum(axis=1)
            bound = lower.astype(float) - self.moved[stamp, p, np.arange(self.groups)]
            scan = np.ones((n, self.groups), bool) if fresh else bound <= (np.sqrt(own) * (1 + SLACK))[:, None]
            best, entry = own.copy(), code.astype(np.int64)
            found = []
            for g, members in enumerate(self.members[p]):
                rows = np.flatnonzero(scan[:, g])
                if not len(rows) or not len(members):
                    continue
                far = squared(piece[rows], book[members], exact_in_float)
                at = far.argmin(axis=1)
                least = far[np.arange(len(rows)), at]
                far[np.arange(len(rows)), at] = np.iinfo(np.int64).max
                found.append((g, rows, members[at], least, far.min(axis=1)))
                scanned[rows] += len(members)
                better = (least < best[rows]) | ((least == best[rows]) & (members[at] < entry[rows]))
                best[rows[better]], entry[rows[better]] = least[better], members[at][better]
            left = np.flatnonzero(entry != code)
            home = self.group[p][code[left]]
            left, home = left[~scan[left, home]], home[~scan[left, home]]
            # The entry just left is one of the others of its group from now on.
            lower[left, home] = below(np.minimum(bound[left, home], np.sqrt(own[left])))
            stamp[left, home] = now
            for g, rows, first, least, second in found:
                others = np.where(first == entry[rows], second, least).astype(float)
                others[others >= float(np.iinfo(np.int64).max)] = np.inf
                lower[rows, g], stamp[rows, g] = below(np.sqrt(others)), now
            code[:] = entry
            error += best
            scanned += 1
        return error, scanned


def below(x: np.ndarray) -> np.ndarray:
    """Doubles as 32-bit floats that are not larger."""
    return np.nextafter((x * (1 - SLACK)).astype(np.float32), np.float32(-np.inf))


def _assigned(rows: DataFrame, books: Codebooks, width: int, exact_in_float: bool, label: str, fresh: bool) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(books)
    dtype = layout(books.history.shape[1], books.groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for rows in batches:
            if not rows.num_rows:
                continue
            x = matrix(rows.column("x"), width)
            if fresh:
                state = np.zeros(len(x), dtype)
            else:
                state = np.frombuffer(b"".join(rows.column("state").to_pylist()), dtype).copy()
            error, scanned = known.assign(x, state, fresh, exact_in_float)
            if not fresh:
                scanned += rows.column("scanned").to_numpy()
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dtype.itemsize), len(x), [None, pa.py_buffer(state.tobytes())])
            columns = [rows.column("vec_id"), rows.column("label"), rows.column("x"), packed.cast(pa.binary()), pa.array(error), pa.array(scanned)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "x", "state", "error", "scanned"])

    return materialize(rows.mapInArrow(run, _STATE.format(label=label)))


def _means(state: DataFrame, books: Codebooks, width: int) -> np.ndarray:
    """The next codebooks: one sum per part, entry and task is shuffled."""
    present = books.history[-1]
    parts, entries, wide = present.shape
    dtype = layout(parts, books.groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count = np.zeros((parts, entries, wide), np.int64), np.zeros((parts, entries), np.int64)
        for rows in batches:
            x = matrix(rows.column("x"), width)
            code = np.frombuffer(b"".join(rows.column("state").to_pylist()), dtype)["code"]
            for p, piece in enumerate(np.split(x, parts, axis=1)):
                np.add.at(sums[p], code[:, p], piece)
                count[p] += np.bincount(code[:, p], minlength=entries)
        part, entry = np.nonzero(count)
        if len(part):
            flat = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * wide, sums[part, entry].ravel())
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), flat], ["part", "entry", "n", "sums"]
            )

    each = state.select("x", "state").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
    totals = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(wide)]).alias("sums"))
    books = present.copy()
    for r in totals.collect():  # at most parts x entries rows
        books[r["part"], r["entry"]] = [s // r["n"] for s in r["sums"]]
    return books


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, groups: int = GROUPS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error, scanned) per row, final codebooks).

    ``scanned`` counts the distances measured for a row over all rounds; a full
    scan of every round would be (rounds + 1) x parts x entries.
    """
    rows = whole(vectors, scale, 0, F.col("vec_id").cast("bigint").alias("vec_id"), "label")
    n, width, low, high = measure(rows)
    if width % parts or (n and not width):
        raise ValueError(f"{width} components do not make {parts} equal parts")
    label = rows.schema["label"].dataType.simpleString()
    if not n:
        none = rows.sparkSession.createDataFrame([], f"vec_id bigint, label {label}, code string, error bigint, scanned bigint")
        return none, np.zeros((parts, 0, 0), np.int64)
    top = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").collect()
    first = np.array([r["x"] for r in top], np.int64).reshape(len(top), parts, width // parts).swapaxes(0, 1)
    farthest = width * (2 * max(-low, high)) ** 2
    if farthest >= 1 << 62:
        raise ValueError(f"squared distances between components from {low} to {high} exceed 64 bits")
    exact_in_float = farthest < 1 << 53
    books = Codebooks(first, groups)
    state = _assigned(rows, books, width, exact_in_float, label, fresh=True)
    for _ in range(rounds):
        books.add(_means(state, books, width))
        state = _assigned(state, books, width, exact_in_float, label, fresh=False)
    code = F.lower(F.hex(F.substring("state", 1, parts))).alias("code")
    return state.select("vec_id", "label", code, "error", "scanned"), books.history[-1]


def compress(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256, scanned) per row."""
    coded, books = train(vectors)
    absent, key = F.col("label").isNull().alias("_absent"), F.coalesce("label", F.lit(0).cast(coded.schema["label"].dataType)).alias("_label")
    coded = coded.select("*", absent, key)
    per_label = coded.groupBy("_absent", "_label").agg(F.sum("error").alias("label_error"))
    out = lookup(coded, per_label, ["_absent", "_label"])
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"), "scanned")
