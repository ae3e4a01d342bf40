"""Resharding by minimum-cost flow.

From the bytes in each old shard and the capacity of each new one, a flow that
moves the fewest bytes is solved exactly on the driver (shards, not rows). Bytes
stay free of charge where old and new shard have the same number. The documents
of an old shard stand on a line of bytes, and the flow cuts the line into
stretches that go to the new shards; a document goes where its middle lies.

Documents too large for a fine cut come first on the line, which is the part
that stays, the largest at the front; all others follow in an order given by
hashes, so that which documents move says nothing about them.

``rewrite`` writes only the shards whose set of documents changes.

Defined results: a null text counts as no bytes; rows that share a doc_id, and
equal rows, are placed one by one; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .line import cells

OVERHEAD = 16
FINE = 200


def min_cost_flow(supply: list[int], demand: list[int], cost: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
    """Transfers {(old, new): amount} of least total cost from ``supply`` to ``demand`` (equal sums).

    Successive shortest paths with potentials over the bipartite network; an
    augmentation saturates a supply, a demand or a transfer, and the number of
    shards is small.
    """
    n, m = len(supply), len(demand)
    left, need = list(supply), list(demand)
    flow: dict[tuple[int, int], int] = {}
    potential = [0] * (n + m)
    while any(left):
        far = [0 if i < n and left[i] else None for i in range(n + m)]
        via: list[int | None] = [None] * (n + m)
        queue = [(0, i) for i in range(n) if left[i]]
        done = [False] * (n + m)
        while queue:
            d, u = heapq.heappop(queue)
            if done[u]:
                continue
            done[u] = True
            if u < n:
                steps = [(n + j, cost.get((u, j), 1)) for j in range(m)]
            else:
                steps = [(i, -cost.get((i, u - n), 1)) for i in range(n) if flow.get((i, u - n), 0) > 0]
            for v, c in steps:
                reduced = d + c + potential[u] - potential[v]
                if not done[v] and (far[v] is None or reduced < far[v]):
                    far[v], via[v] = reduced, u
                    heapq.heappush(queue, (reduced, v))
        end = min((far[n + j] + potential[n + j], j) for j in range(m) if need[j] and far[n + j] is not None)[1] + n
        reach = max(d for d in far if d is not None)
        for v in range(n + m):
            potential[v] += far[v] if far[v] is not None else reach
        path, v = [], end
        while via[v] is not None:
            path.append((via[v], v))
            v = via[v]
        amount = min([left[v], need[end - n], *(flow[b, a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a, b - n] = flow.get((a, b - n), 0) + amount
            else:
                flow[b, a - n] -= amount
        left[v] -= amount
        need[end - n] -= amount
    return {k: x for k, x in flow.items() if x}


def even(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def measured(docs: DataFrame, old: Column) -> DataFrame:
    """(doc_id, size, text_crc32, old) per row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.octet_length(text).cast("bigint") + OVERHEAD
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), size.alias("size"), F.crc32(text).alias("text_crc32"), old.cast("int").alias("old"))


def reshard(docs: DataFrame, old: Column, shards: int, capacities: list[int] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, old, shard, slot) per row; ``old`` numbers the present shards from 0.

    Capacities are shares of the bytes, equal ones by default. The driver gets
    one total per old shard and cell of the line.
    """
    rows = materialize(measured(docs, old))
    spark, total = rows.sparkSession, rows.agg(F.count("*"), F.sum("size"), F.max("old")).first()
    if not total[0]:
        return rows.select("*", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    share = capacities or [1] * shards
    parts, fine = cells(total[0]), total[1] // shards // FINE
    # Cells of large documents come first on the line, by falling powers of two.
    spread = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts))
    band = F.floor(F.log2("size")).cast("bigint")
    rows = rows.withColumn("cell", spread - F.when(F.col("size") > fine, band + 1).otherwise(0) * parts)
    sums = sorted(map(tuple, rows.groupBy("old", "cell").agg(F.sum("size")).collect()))
    supply = [0] * (total[2] + 1)
    starts = []
    for o, c, n in sums:
        starts.append((o, c, supply[o]))
        supply[o] += n
    ends = np.cumsum(share) * total[1] // sum(share)
    demand = np.diff(np.concatenate([[0], ends])).tolist()
    flow = min_cost_flow(supply, [int(x) for x in demand], {(i, i): 0 for i in range(len(supply))})
    cuts: dict[int, list[tuple[int, int]]] = {}
    for (o, new), n in sorted(flow.items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):
        cuts.setdefault(o, []).append((n, new))
    at = [(o, c, start, [int(x) for x in np.cumsum([n for n, _ in cuts[o]])], [new for _, new in cuts[o]]) for o, c, start in starts]
    places = spark.createDataFrame(at, "old int, cell bigint, start bigint, ends array<bigint>, news array<int>")
    order = [F.desc(F.greatest("size", F.lit(fine))), F.xxhash64("text_crc32", "doc_id"), F.col("doc_id"), F.col("text_crc32")]
    before = Window.partitionBy("old", "cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).join(places, ["old", "cell"])
    middle = F.col("start") + F.col("before") + F.floor(F.col("size") / 2).cast("bigint")
    passed = F.size(F.filter("ends", lambda x: x <= middle))
    new = F.element_at("news", F.least(passed + 1, F.size("news")))
    placed = materialize(placed.select("doc_id", "size", "text_crc32", "old", new.alias("shard"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)).alias("cell")))
    return _slots(placed)


def _slots(placed: DataFrame) -> DataFrame:
    """Numbers the rows of each shard from 0, gapless, cell by cell."""
    counts = sorted(map(tuple, placed.groupBy("shard", "cell").count().collect()))
    first, seen = [], {}
    for shard, cell, n in counts:
        first.append((shard, cell, seen.get(shard, 0)))
        seen[shard] = seen.get(shard, 0) + n
    firsts = placed.sparkSession.createDataFrame(first, "shard int, cell bigint, first bigint")
    number = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "old"))
    out = placed.withColumn("number", number).join(firsts, ["shard", "cell"])
    return out.select("doc_id", "size", "text_crc32", "old", "shard", (F.col("first") + F.col("number") - 1).alias("slot"))


def rewrite(docs: DataFrame, plan: DataFrame, root: str, generation: str) -> list[int]:
    """Writes the shards that gain or lose documents as ``root/generation/shard=N``; returns their numbers.

    Shards without a change keep their present files. ``docs`` needs unique ids.
    """
    moved = plan.where("old <> shard")
    touched = sorted({r[0] for r in moved.select("shard").union(moved.select("old")).distinct().collect()})
    rows = plan.where(F.col("shard").isin(touched)).select("doc_id", "shard", "slot")
    body = docs.join(rows, "doc_id").repartition("shard").sortWithinPartitions("shard", "slot")
    body.write.partitionBy("shard").mode("errorifexists").parquet(f"{root}/{generation}")
    return touched
