"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets: sources in code-point order (null last) share the words of the whole
table by weight; a source gives at most ``repeats`` times its size, and what is
above goes to the others by weight. Words are counted in blocks of equal size.
Seats of ``block`` words go to sources by the highest quotients target/(2s+1),
then the seats of a source to its shards by the same rule over shard sizes, so
each shard knows its integer quota. A shard is taken whole as often as its quota
covers it, and a seeded choice of its blocks once more.

A shard is a hash range of the documents of a source; its documents stand in
seeded order on a line of words which the blocks cut. A document's words may lie
in several blocks.

What reaches the driver: one row per source and shard (about one per
``ROWS_PER_CELL`` documents). Defined results: a null or empty text has size 0
and nothing is taken from it; null is a source of its own; rows that share a
doc_id count one by one, equal rows included; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..joins import bounded_broadcast
from ..session import materialize
from .line import cells
from .text import batch, stretches, utf8, words

WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK = 16
_WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], repeats: int = REPEATS) -> list[float]:
    """Shares of sum(sizes) by weight; none above ``repeats`` times its size, the excess shared anew."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / total > repeats * sizes[i]]
        if not full:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(repeats * sizes[i])
        left -= sum(out[i] for i in full)
        free -= set(full)
    return out


def sainte_lague(votes: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by the highest quotients votes/(2s+1); ties go to the earlier entry.

    Whole parts at a divisor slightly too large are given at once; only the last
    few seats, at most a few per entry, need the queue of quotients.
    """
    total = sum(votes)
    if seats <= 0 or total <= 0:
        return [0] * len(votes)
    most = most if most is not None else [seats] * len(votes)
    divisor = total / seats
    # A seat count of floor(v/d) - 1 stands in the outcome as long as the final divisor is at most about d.
    given = [min(m, max(0, int(v / divisor) - 1)) for v, m in zip(votes, most, strict=True)]
    while sum(given) > seats:  # only if caps hold some back and rounding overshoots
        divisor *= 1.0 + 1.0 / seats
        given = [min(m, max(0, int(v / divisor) - 1)) for v, m in zip(votes, most, strict=True)]
    queue = [(-v / (2 * g + 1), i) for i, (v, g, m) in enumerate(zip(votes, given, most, strict=True)) if g < m and v > 0]
    heapq.heapify(queue)
    for _ in range(seats - sum(given)):
        if not queue:
            break
        _, i = heapq.heappop(queue)
        given[i] += 1
        if given[i] < most[i]:
            heapq.heappush(queue, (-votes[i] / (2 * given[i] + 1), i))
    return given


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, stamp): words of each text, and a checksum of it to order equal ids by."""
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("size", pa.int64()), ("stamp", pa.int64())])

    def run(batches):
        for rows in batches:
            data, offsets = utf8(rows.column("text"))
            counts = [np.zeros(0, np.int64)]
            for lo, hi in stretches(offsets):
                counts.append(np.diff(words(data, offsets[lo : hi + 1], lower=False)[3]))
            stamps = [zlib.crc32(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield batch(schema, doc_id=rows.column("doc_id"), source=rows.column("source"), size=np.concatenate(counts), stamp=stamps)

    picked = docs.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("text").cast("string"))
    return picked.mapInArrow(run, "doc_id bigint, source string, size bigint, stamp bigint")


def taken_before(words: int, quota: int, block: int, seed: int):
    """A function of places on a line of ``words``: words taken before them, ``quota * block`` in all.

    The line is taken whole as often as that goes; of the rest, a seeded choice
    of its full blocks is taken once more, and the beginning of one last block.
    """
    whole, rest = divmod(quota * block, words) if words else (0, 0)
    full = words // block
    order = np.random.default_rng(seed).permutation(full)
    extra = np.zeros(full + 1, np.int64)
    extra[order[: rest // block]] = block
    sums = np.concatenate([[0], np.cumsum(extra)])
    last = int(order[rest // block]) if rest // block < full else full

    def of(at: np.ndarray) -> np.ndarray:
        k = at // block
        inside = np.minimum(at - k * block, extra[np.minimum(k, full)])
        return whole * at + sums[k] + inside + np.clip(at - last * block, 0, rest % block)

    return of


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, repeats: int = REPEATS, seed: int = 0) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, stamp) per row of ``docs``."""
    rows = materialize(sized(docs))
    spark, shards = rows.sparkSession, cells(rows.count())
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "stamp", F.lit(seed)), F.lit(shards)))
    found = rows.groupBy("source", "shard").agg(F.sum("size").alias("words")).collect()
    names = sorted({r["source"] for r in found}, key=lambda x: (x is None, (x or "").encode("utf-8", "surrogatepass")))
    by_shard = {name: [] for name in names}
    for r in sorted(found, key=lambda r: r["shard"]):
        by_shard[r["source"]].append((r["shard"], r["words"]))
    sizes = [sum(n for _, n in by_shard[x]) for x in names]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], repeats)
    room = [[repeats * n // block for _, n in by_shard[x]] for x in names]
    seats = sainte_lague(wanted, round(sum(wanted) / block), [sum(x) for x in room])
    plan = []
    for name, size, target, given, most in zip(names, sizes, wanted, seats, room, strict=True):
        for (shard, n), quota in zip(by_shard[name], sainte_lague([float(n) for _, n in by_shard[name]], given, most), strict=True):
            plan.append((name, shard, n, quota, size, target))
    quotas = spark.createDataFrame(plan, "source string, shard bigint, words bigint, quota bigint, source_size bigint, target double")

    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("stamp", pa.int64()), ("size", pa.int64()), ("source_size", pa.int64()), ("target", pa.float64()), ("taken", pa.int64())])

    def run(key, table):
        order = np.lexsort((table.column("stamp").to_numpy(), table.column("mark").to_numpy()))
        table = table.take(pa.array(order))
        size = table.column("size").to_numpy()
        n, quota = table.column("words")[0].as_py(), table.column("quota")[0].as_py()
        ends = np.cumsum(size)
        label = "\x00null" if key[0].as_py() else key[1]
        of = taken_before(n, quota, block, zlib.crc32(f"{seed}/{label}/{key[2]}".encode()))
        taken = of(ends) - of(ends - size)
        return pa.table({**{x: table.column(x) for x in schema.names[:-1]}, "taken": pa.array(taken)}, schema=schema)

    # Null-safe on source; the plan is a row per source and shard and joins by shuffle or broadcast as Spark sees fit.
    same = rows["source"].eqNullSafe(quotas["source"]) & (rows["shard"] == quotas["shard"])
    placed = rows.join(quotas, same).select(rows["doc_id"], rows["source"], "stamp", "size", rows["shard"], "words", "quota", "source_size", "target", F.xxhash64("doc_id", F.lit(seed)).alias("mark"))
    group = [F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"), "shard"]
    return placed.groupBy(*group).applyInArrow(run, "doc_id bigint, source string, stamp bigint, size bigint, source_size bigint, target double, taken bigint")


def apply_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, repeats: int = REPEATS, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns.

    A document taken n times and a part stands n times, and once more with a
    chance of that part, by a hash of its id and text. Rows are matched by
    doc_id, source and checksum of the text; equal rows take the least of their counts.
    """
    counts = mix(docs, weights, block, repeats, seed)
    part = F.col("taken") / F.greatest("size", F.lit(1))
    chance = F.pmod(F.xxhash64("doc_id", "stamp", F.lit(seed + 1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = (F.floor(part) + (chance < part - F.floor(part)).cast("int")).cast("int")
    counts = counts.groupBy(F.col("doc_id").alias("__id"), F.col("stamp").alias("__stamp"), F.col("source").alias("__source")).agg(F.min(copies).alias("__copies")).where("__copies > 0")
    counts = bounded_broadcast(materialize(counts))
    same = docs["doc_id"].eqNullSafe(counts["__id"]) & (F.crc32(F.coalesce(docs["text"], F.lit(""))) == counts["__stamp"]) & docs["source"].eqNullSafe(counts["__source"])
    return docs.join(counts, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[docs[x] for x in docs.columns])
