"""Connected components of links between documents, as Spark joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Links whose components a task finds at once.
PIECE = 1 << 16


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) to stars, piece by piece: each node with the smallest that the links of its piece lead to."""
    waiting, rows = [], 0
    for x in batches:
        for lo in range(0, x.num_rows, PIECE):
            waiting.append(x.slice(lo, PIECE))
            rows += waiting[-1].num_rows
            if rows >= PIECE:
                yield _star(waiting)
                waiting, rows = [], 0
    if rows:
        yield _star(waiting)


def _star(piece: list[pa.RecordBatch]) -> pa.RecordBatch:
    ends = [np.concatenate([x.column(c).to_numpy() for x in piece]) for c in ("u", "v")]
    nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, j in at.reshape(2, -1).T.tolist():
        i, j = root(i), root(j)
        parent[max(i, j)] = min(i, j)
    least = nodes[[root(i) for i in range(len(nodes))]]
    return pa.RecordBatch.from_arrays([pa.array(x[nodes != least], pa.int64()) for x in (nodes, least)], ["u", "v"])


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b); a component is named by its smallest node.

    Tasks turn pieces of ``PIECE`` links into stars, which is all if one piece
    holds them. Stars of several pieces meet in large-star and small-star steps
    in turn: every step points the neighbours of a node at the smallest of them,
    so the links of a node are never listed in one place, and a few steps reach
    the stars. Both ends of a link must differ.
    """
    edges = materialize(links.select(F.greatest("a", "b").cast("bigint").alias("u"), F.least("a", "b").cast("bigint").alias("v")))
    pieces = -(-edges.count() // PIECE)
    if not pieces:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    edges = materialize(edges.coalesce(pieces).mapInArrow(_stars, "u bigint, v bigint"))
    if pieces > 1:
        edges = _meet(edges, rounds)
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())


def _meet(edges: DataFrame, rounds: int) -> DataFrame:
    """Large-star and small-star steps until the links (u, v) stay the same."""
    stamp = None
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        before, stamp = stamp, _stamp(edges)
        if stamp == before:
            return edges
    raise RuntimeError(f"components did not settle in {rounds} rounds")
