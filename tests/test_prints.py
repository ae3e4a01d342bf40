"""Increments told by prints, against the join of whole rows."""

import glob
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark import operators as op
from tidemark.operators import prints as pr
from tidemark.plans import backup_full, backup_incremental, restore_table
from tidemark.plans.snapshots import increment_by_prints
from tidemark.sources.store import SnapshotInfo, read_buckets, read_snapshot

SCHEMA = "a BIGINT, b STRING, v DOUBLE, w STRING, op_ ARRAY<STRING>"
KEY = ["a", "b"]


def rows(df):
    return sorted((tuple(map(str, r)) for r in df.select("a", "b", "v", "w", "op_").collect()))


def changes(df):
    return sorted(tuple(map(str, r)) for r in df.select("a", "b", "op", "v", "w", "op_").collect())


def edit(rng, state, n=25):
    out = dict(state)
    for k in rng.sample(sorted(out, key=str), min(n, len(out))):
        kind = rng.randrange(4)
        if kind == 0:
            del out[k]
        else:
            v, w, x = out[k]
            out[k] = [(None, w, x), (v, "", x), (v, None, [None, "é"])][kind - 1]
    for _ in range(n):
        out[rng.choice([None, rng.randrange(10**6)]), rng.choice([None, "", "k", str(rng.randrange(50))])] = (rng.random(), "new", None)
    return out


def table(spark, state, parts=3):
    df = spark.createDataFrame([(*k, *v) for k, v in state.items()], SCHEMA)
    return df.repartition(parts) if state else df


@pytest.fixture
def small_buckets(monkeypatch):
    monkeypatch.setattr(pr, "ROWS_PER_BUCKET", 16)


def test_a_chain_of_increments_equals_row_comparison(spark, workdir, small_buckets):
    rng = random.Random(5)
    state = {(i, str(i % 3)): (float(i), "w", ["x"]) for i in range(900)} | {(None, "n"): (1.0, None, None), (None, None): (2.0, "", [])}
    name, states = "20260101T000000F", [state]
    backup_full(table(spark, state), workdir, SnapshotInfo(name), KEY)
    for day in range(2, 6):
        state = edit(rng, state) if day != 4 else dict(state)
        parent, name = name, f"{name}_2026010{day}T000000I"
        backup_incremental(table(spark, state), workdir, SnapshotInfo(name, "incremental", parent), KEY)
        stored = read_snapshot(spark, workdir, name)
        assert changes(stored) == changes(op.incremental_snapshot(table(spark, states[-1]), table(spark, state), KEY))
        states.append(state)
        assert rows(restore_table(spark, workdir, name, KEY)) == rows(table(spark, state))
    # Every bucket is described, by the snapshot that changed it last.
    buckets = read_buckets(spark, workdir, name)
    assert buckets.agg(F.sum("rows")).first()[0] == len(state)
    assert buckets.select("holder").distinct().count() > 2


def test_only_differing_buckets_are_read(spark, workdir, small_buckets):
    state = {(i, "k"): (float(i), "w", None) for i in range(2000)}
    backup_full(table(spark, state), workdir, SnapshotInfo("20260101T000000F"), KEY)
    bits = read_buckets(spark, workdir, "20260101T000000F").first()["bits"]
    changed = state | {(7, "k"): (0.5, "w", None)}
    bucket = table(spark, {(7, "k"): changed[7, "k"]}).select(pr.bucket_of(KEY, bits)).first()[0]
    # All other folders of prints, and the data, may be gone.
    for path in glob.glob(f"{workdir}/*/prints/folder=*/*.parquet") + glob.glob(f"{workdir}/*/data/*.parquet"):
        if f"folder={bucket % pr.FOLDERS}/" not in path:
            os.truncate(path, 10)
    name = "20260101T000000F_20260102T000000I"
    backup_incremental(table(spark, changed), workdir, SnapshotInfo(name, "incremental", "20260101T000000F"), KEY)
    assert changes(read_snapshot(spark, workdir, name)) == [("7", "k", "U", "0.5", "w", "None")]


def test_values_are_in_no_exchange(spark, workdir, small_buckets):
    state = {(i, "k"): (float(i), "w", None) for i in range(500)}
    source = f"{workdir}/source"
    backup_full(table(spark, state), f"{workdir}/r", SnapshotInfo("20260101T000000F"), KEY)
    table(spark, state | {(7, "k"): (0.5, "w", None)}).write.parquet(source)
    df = spark.read.parquet(source)
    old = read_buckets(spark, f"{workdir}/r", "20260101T000000F")
    info = SnapshotInfo("20260101T000000F_20260102T000000I", "incremental", "20260101T000000F")
    changed, _ = increment_by_prints(df, f"{workdir}/r", info, KEY, old)
    plan = changed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    new = pr.bucket_prints(pr.row_prints(df, KEY, 5), KEY)
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(bucket", plan) and "partial_count" in plan
    assert changed.count() == 1


def test_empty_states(spark, workdir):
    some = {(1, "k"): (1.0, "w", None)}
    backup_full(table(spark, {}), workdir, SnapshotInfo("20260101T000000F"), KEY)
    one, two, three = "20260101T000000F_20260102T000000I", "20260101T000000F_20260102T000000I_20260103T000000I", "20260101T000000F_20260102T000000I_20260103T000000I_20260104T000000I"
    backup_incremental(table(spark, some), workdir, SnapshotInfo(one, "incremental", "20260101T000000F"), KEY)
    backup_incremental(table(spark, {}), workdir, SnapshotInfo(two, "incremental", one), KEY)
    backup_incremental(table(spark, some), workdir, SnapshotInfo(three, "incremental", two), KEY)
    assert rows(restore_table(spark, workdir, one, KEY)) == rows(restore_table(spark, workdir, three, KEY)) == rows(table(spark, some))
    assert restore_table(spark, workdir, two, KEY).count() == 0


def test_a_parent_without_prints_is_rebuilt(spark, workdir):
    some = {(i, "k"): (1.0, "w", None) for i in range(9)}
    backup_full(table(spark, some), workdir, SnapshotInfo("20260101T000000F"))
    name = "20260101T000000F_20260102T000000I"
    backup_incremental(table(spark, some | {(None, "k"): (2.0, None, None)}), workdir, SnapshotInfo(name, "incremental", "20260101T000000F"), KEY)
    assert changes(read_snapshot(spark, workdir, name)) == [("None", "k", "I", "2.0", "None", "None")]


def test_null_keys_are_keys(spark):
    make = lambda *r: spark.createDataFrame(list(r), "k INT, v STRING")
    same = op.incremental_snapshot(make((None, "a"), (1, "b")), make((None, "a"), (1, "c")), ["k"]).collect()
    assert [(r["k"], r["op"], r["v"]) for r in same] == [(1, "U", "c")]
    gone = op.incremental_snapshot(make((None, "a")), make((1, "b")), ["k"])
    assert sorted(map(str, ((r["k"], r["op"]) for r in gone.collect()))) == ["(1, 'I')", "(None, 'D')"]
    assert [tuple(r) for r in op.restore_chain(make((None, "a")), [gone], ["k"]).collect()] == [(1, "b")]


def test_bits_follow_the_rows():
    assert [pr.bits_for(n) for n in (0, 1024, 1025, 4096, 1 << 26, 1 << 40)] == [0, 0, 1, 2, 16, 16]
