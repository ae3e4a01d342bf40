"""Tasks of equal bytes, and repositories verified by them."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.plans import verify
from tidemark.sources import objects as obj

from .builder import Builder, day, flip_middle


def loads(df, open_bytes=obj.OPEN_BYTES):
    out = defaultdict(int)
    for r in df.select(F.spark_partition_id().alias("task"), "size").collect():
        out[r["task"]] += (r["size"] or 0) + open_bytes
    return out


@pytest.mark.parametrize("cell", [40, 100_000])
def test_tasks_hold_equal_bytes_however_sizes_are_spread(spark, monkeypatch, cell):
    monkeypatch.setattr(obj, "_ROWS_PER_CELL", cell)
    # One directory with nearly all bytes, very many empty files, a few huge ones, one of unknown size.
    sizes = [0] * 900 + [7 << 20] * 60 + [1 << 30] * 2 + [None] + [100] * 300
    rows = [(("a/" if s and s > 1000 else "b/") + f"{i}", s) for i, s in enumerate(sizes)]
    spread = obj.spread_by_bytes(spark.createDataFrame(rows, "path STRING, size BIGINT"), task_bytes=16 << 20)
    assert sorted(map(tuple, spread.collect()), key=str) == sorted(rows, key=str)
    total = sum((s or 0) + obj.OPEN_BYTES for s in sizes)
    tasks = -(-total // (16 << 20))
    assert spread.rdd.getNumPartitions() == tasks
    huge = 1 << 30
    held = loads(spread)
    assert sorted(v for v in held.values() if v >= huge)[-2:] and sum(v >= huge for v in held.values()) == 2
    assert all(v <= total / tasks + (8 << 20) for v in held.values() if v < huge)


def test_few_files_keep_the_cores_busy_and_none_is_fine(spark):
    few = spark.createDataFrame([(f"{i}", 5) for i in range(10)], "path STRING, size BIGINT")
    assert len(loads(obj.spread_by_bytes(few))) == 10
    assert obj.spread_by_bytes(few.limit(0)).count() == 0


def test_verify_deals_bodies_by_bytes(spark, workdir, monkeypatch):
    b = Builder(workdir)
    big = {f"base/{i}": bytes([i]) * (200_000 if i < 3 else 10) for i in range(30)}
    one, two = b.full(day(0), files=big), b.full(day(1), files={"PG_VERSION": b"18", "base/1": b"x" * 50}, codec="gzip")
    flip_middle(f"{workdir}/{one}/base/2")
    dealt = []
    spread = obj.spread_by_bytes
    monkeypatch.setattr(obj, "spread_by_bytes", lambda rows, location="path", **k: dealt.append((set(rows.columns), location)) or spread(rows, location, **k))
    summary, bad = verify(spark, workdir)
    assert [(r["path"], r["status"]) for r in bad.collect()] == [("base/2", "MISMATCH")]
    assert {r["backup_id"]: r["status"] for r in summary.collect()} == {one: "FAILED", two: "OK"}
    assert any({"size", "codec", "location"} <= columns and location == "location" for columns, location in dealt)
