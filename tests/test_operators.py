"""Operators on small tables against plain Python, incl. skewed and shuffled inputs."""

import random
from collections import defaultdict
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.builder import day
from tidemark import operators as op
from tidemark.functions import Target
from tidemark.operators import Policy

BACKUP = "backup_id STRING, type STRING, parent_backup_id STRING, server STRING, start_lsn BIGINT, stop_time TIMESTAMP"


def backups(spark, rows):
    return spark.createDataFrame(rows, BACKUP)


def full(i, t, lsn=100, server="a"):
    return (i, "full", None, server, lsn, t)


def inc(i, parent, t=None, server="a"):
    return (i, "incremental", parent, server, 100, t or day(0))


def kept(plan):
    return sorted(r["backup_id"] for r in plan.where("kept").collect())


# --- chains ---------------------------------------------------------------


def test_chain_statuses(spark):
    rows = [full("r", day(0)), inc("a", "r"), inc("b", "a"), inc("c", "b"), inc("x", "gone"), inc("y", "x"), inc("n", None), inc("m", "n")]
    rows += [inc("p", "q"), inc("q", "p"), inc("s", "s"), inc("t", "p")]
    got = {r["backup_id"]: (r["chain_id"], r["depth"], r["status"]) for r in op.resolve_chains(backups(spark, rows)).collect()}
    assert got == {
        "r": ("r", 0, "ok"), "a": ("r", 1, "ok"), "b": ("r", 2, "ok"), "c": ("r", 3, "ok"),
        "x": (None, None, "missing_parent"), "y": (None, None, "missing_parent"),
        "n": (None, None, "no_parent"), "m": (None, None, "no_parent"),
        "p": (None, None, "cycle"), "q": (None, None, "cycle"), "s": (None, None, "cycle"), "t": (None, None, "cycle"),
    }
    assert len(got) == len(rows)


def test_deep_chain(spark):
    n = 130
    rows = [full("b000", day(0))] + [inc(f"b{i:03}", f"b{i - 1:03}") for i in range(1, n)]
    got = {r["backup_id"]: r for r in op.resolve_chains(backups(spark, rows)).collect()}
    assert all(got[f"b{i:03}"]["depth"] == i for i in range(n))
    limited = {r["backup_id"]: r["status"] for r in op.resolve_chains(backups(spark, rows), max_depth=64).collect()}
    assert [limited[f"b{i:03}"] for i in (63, 64, 129)] == ["ok", "too_deep", "too_deep"]


def test_hot_parent_is_split(spark):
    """A third of all rows under one parent: the join partition is split, the result whole."""
    n = 60000
    ids = spark.range(n).withColumn("k", F.col("id"))
    rows = ids.select(
        F.format_string("b%07d", "k").alias("backup_id"),
        F.when(F.col("k") % 50 == 0, "full").otherwise("incremental").alias("type"),
        F.when(F.col("k") % 50 != 0, F.when(F.col("k") % 3 == 0, "b0000001").otherwise(F.format_string("b%07d", F.col("k") - F.col("k") % 50))).alias("parent_backup_id"),
    )
    small = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, value in small.items():
            spark.conf.set(k, value)
        got = op.resolve_chains(rows).where("status = 'ok'")
        assert got.count() == rows.count()
        parents = rows.select(F.col("backup_id").alias("parent_backup_id"), F.lit(1).alias("x"))
        joined = rows.join(parents, "parent_backup_id", "left")
        joined.write.format("noop").mode("overwrite").save()
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, value in before.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)


def test_orphans(spark):
    rows = [full("r", day(0)), inc("a", "r"), inc("x", "gone"), inc("n", None)]
    got = {r["backup_id"]: r["reason"] for r in op.orphans(backups(spark, rows)).collect()}
    assert got == {"x": "missing_parent", "n": "no_parent"}


# --- retention ------------------------------------------------------------


def test_keep_n(spark):
    rows = [full("f1", day(0)), full("f2", day(1)), full("f3", day(2))]
    assert kept(op.retention_plan(backups(spark, rows), Policy(now=day(3), keep_fulls=2))) == ["f2", "f3"]


def test_chain_unity(spark):
    rows = [full("f1", day(0)), inc("i1", "f1", day(5)), inc("i2", "i1", day(6)), full("f2", day(3)), inc("o", "gone")]
    plan = op.retention_plan(backups(spark, rows), Policy(now=day(7), keep_fulls=1))
    assert kept(plan) == ["f2"]
    assert sorted(r["backup_id"] for r in plan.where("not kept").collect()) == ["f1", "i1", "i2"]


def test_keep_age_is_strict(spark):
    rows = [full("f1", day(-5)), full("f2", day(-4)), full("f3", day(-1)), full("edge", day(-2)), full("unknown", None)]
    assert kept(op.retention_plan(backups(spark, rows), Policy(now=day(0), keep_full_age=2 * 86400))) == ["f3"]


def test_keep_daily_and_ties(spark):
    rows = [full("f1", day(0)), full("f2", day(0.1)), full("g2", day(0.1)), full("f3", day(1)), full("future", day(9))]
    assert kept(op.retention_plan(backups(spark, rows), Policy(now=day(1.2), keep_daily=2))) == ["f2", "f3"]


def test_empty_policy():
    with pytest.raises(ValueError):
        Policy(now=day(0))


def test_null_stop_time_ranks_last(spark):
    rows = [full("a", None), full("b", day(0))]
    assert kept(op.retention_plan(backups(spark, rows), Policy(now=day(1), keep_fulls=1))) == ["b"]


def test_plan_is_repeatable_and_order_free(spark):
    rng = random.Random(5)
    rows = [full(f"f{i:02}", day(rng.randrange(90)), lsn=i * 10) for i in range(40)]
    rows += [inc(f"i{i:02}", f"f{i % 45:02}") for i in range(60)]
    policy = Policy(now=day(95), keep_fulls=3, keep_daily=5, keep_weekly=4, keep_monthly=3, keep_full_age=5 * 86400)
    one = op.retention_plan(backups(spark, rows), policy).orderBy("backup_id").collect()
    rng.shuffle(rows)
    two = op.retention_plan(backups(spark, rows).repartition(7), policy).orderBy("backup_id").collect()
    assert one == two and any(r["kept"] for r in one) and any(not r["kept"] for r in one)


def test_newest_per_group_with_hot_group(spark):
    rows = [full(f"h{i:04}", day(0) + timedelta(minutes=i % 97), server="hot") for i in range(500)]
    rows += [full(f"c{i}", day(i), server=f"s{i % 5}") for i in range(20)]
    want = defaultdict(list)
    for r in sorted(sorted(rows, key=lambda r: r[0]), key=lambda r: r[5], reverse=True):
        want[r[3]].append(r[0])
    got = op.newest_chains(backups(spark, rows), 3, "server", salts=8)
    assert sorted(r["backup_id"] for r in got.collect()) == sorted(x for ids in want.values() for x in ids[:3])


def test_low_water(spark):
    rows = [full("a", day(0), 500), full("b", day(1), 300), full("c", day(2), None)]
    b = backups(spark, rows)

    def water(**rules):
        r = op.low_water(b, op.kept_fulls(b, Policy(now=day(3), **rules))).first()
        return r["low_water_lsn"], r["reason"]

    assert water(keep_fulls=3) == (None, "unreadable start position")
    assert water(keep_full_age=1) == (None, "nothing kept")
    assert op.low_water(b, spark.createDataFrame([("a",), ("b",)], "chain_id STRING")).first()[0] == 300


def test_null_low_water_prunes_nothing(spark):
    segments = spark.createDataFrame([(1, "x", "segment", 1)], "tli BIGINT, name STRING, kind STRING, seg_no BIGINT")
    assert op.prune_segments(segments, F.lit(None).cast("bigint")).count() == 0
    assert op.prune_segments(segments, F.lit(1 << 26)).count() == 1


# --- archive --------------------------------------------------------------


def test_segment_gaps_cross_stretches(spark):
    present = sorted(set(range(0, 40)) - {5, 6, 15, 16, 17, 32} | {100, 357})
    df = spark.createDataFrame([(1, n, "segment") for n in present * 2], "tli BIGINT, seg_no BIGINT, kind STRING")
    want = [(1, a + 1, b - 1) for a, b in zip(present, present[1:]) if b > a + 1]
    for bucket in (1, 4, 16, 1 << 16):
        assert sorted(tuple(r) for r in op.segment_gaps(df, bucket).collect()) == want


def test_push_cases(spark):
    stored = spark.createDataFrame([(1, "A", "x"), (1, "B", "x"), (1, "B", "y")], "tli BIGINT, name STRING, sha256 STRING")
    pushed = [(1, "A", "x")] * 8 + [(1, "A", "z"), (1, "B", "x"), (1, "B", "q"), (1, "C", "x"), (1, "C", "x"), (1, "D", "p"), (1, "D", "q")]
    got = op.classify_push(spark.createDataFrame(pushed, "tli BIGINT, name STRING, sha256 STRING"), stored).collect()
    assert {(r["name"], r["sha256"]): (r["status"], r["copies"]) for r in got} == {
        ("A", "x"): ("duplicate", 8), ("A", "z"): ("conflict", 1), ("B", "x"): ("duplicate", 1), ("B", "q"): ("conflict", 1),
        ("C", "x"): ("new", 2), ("D", "p"): ("conflict", 1), ("D", "q"): ("conflict", 1),
    }


def test_ingest_is_idempotent(spark, workdir):
    from tidemark.sources.store import archive_ingest, read_archive

    schema = "tli BIGINT, name STRING, sha256 STRING, size BIGINT"
    first = spark.createDataFrame([(1, "A", "x", 5)] * 8 + [(2, "B", "y", 6)], schema)
    archive = f"{workdir}/archive"
    for _ in range(2):
        archive_ingest(first, archive, "1").collect()
    verdict = archive_ingest(spark.createDataFrame([(1, "A", "z", 5), (1, "C", "c", 7), (2, "B", "y", 6)], schema), archive, "2")
    assert {r["name"]: r["status"] for r in verdict.collect()} == {"A": "conflict", "C": "new", "B": "duplicate"}
    assert sorted((r["tli"], r["name"], r["sha256"]) for r in read_archive(spark, archive).collect()) == [(1, "A", "x"), (1, "C", "c"), (2, "B", "y")]


def test_summary_gaps_brute_force(spark):
    rng = random.Random(11)
    rows = [(t, s, s + rng.randrange(1, 60)) for t in (1, 2) for s in rng.sample(range(3000), 120)]
    df = spark.createDataFrame(rows, "tli BIGINT, start_lsn BIGINT, end_lsn BIGINT")
    for lo, hi in ((None, None), (500, 2500)):
        want = []
        for t in (1, 2):
            spans = [(max(s, lo or 0), min(e, hi or e)) for x, s, e in rows if x == t]
            covered = {p for s, e in spans for p in range(s, e)}
            a = lo if lo is not None else min(covered)
            b = hi if hi is not None else max(covered) + 1
            p = a
            while p < b:
                if p in covered:
                    p += 1
                    continue
                q = p
                while q < b and q not in covered:
                    q += 1
                want.append((t, p, q))
                p = q
        for bucket in (50, 700, 1 << 40):
            assert sorted(tuple(r) for r in op.summary_gaps(df, lo, hi, bucket).collect()) == sorted(want)


# --- blocks ---------------------------------------------------------------


def test_changed_in_windows_brute_force(spark):
    rng = random.Random(3)
    changes = [(rng.choice([1, 2]), rng.randrange(4), 0, rng.randrange(50), rng.randrange(2000)) for _ in range(1500)]
    changes += [(1, 9, 1, 7, p) for p in range(0, 2000, 2)]  # one block owns many changes
    windows = [(i, rng.choice([1, 2]), a, a + rng.choice([0, 1, 16, 100, 900])) for i, a in enumerate(rng.sample(range(1500), 30))]
    got = op.changed_in_windows(
        spark.createDataFrame(changes, "tli BIGINT, rel BIGINT, fork INT, block_no BIGINT, lsn BIGINT"),
        spark.createDataFrame(windows, "window_id BIGINT, tli BIGINT, start_lsn BIGINT, end_lsn BIGINT"),
        bucket=16,
    ).collect()
    want = {(w, r, f, b) for w, t, lo, hi in windows for t2, r, f, b, p in changes if t == t2 and lo <= p < hi}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_combine_chain_with_pages(spark):
    page = lambda c: bytes([c]) * 8
    rows = [("f", 0, b, page(0)) for b in range(6)] + [("f", 1, 2, page(1)), ("f", 2, 2, page(2)), ("f", 1, 9, page(1)), ("g", 0, 0, page(7))]
    blocks = spark.createDataFrame(rows, "path STRING, chain_pos INT, block_no BIGINT, data BINARY")
    limits = spark.createDataFrame([("f", 1, 20), ("f", 2, 8)], "path STRING, chain_pos INT, truncation_block_length BIGINT")
    got = {(r["path"], r["block_no"]): r["data"][0] for r in op.combine_chain(blocks, limits, fill=True, zero_page=bytes(8), chunk=3).collect()}
    want = {("f", b): 0 for b in range(8)} | {("f", 2): 2, ("g", 0): 7}
    assert got == want


def test_page_fingerprint_brute_force(spark):
    import os

    def reference(page, number):
        lanes = list(op.blocks.LANES)
        body = page[:8] + b"\0\0" + page[10:]
        words = [int.from_bytes(body[i : i + 4], "little") for i in range(0, len(body), 4)]
        for i, w in enumerate(words):
            x = lanes[i % 32] ^ w
            lanes[i % 32] = (x * 16777619 & 0xFFFFFFFF) ^ (x >> 17)
        out = 0
        for x in lanes:
            out ^= (x * 16777619 & 0xFFFFFFFF) ^ (x >> 17)
        return (out ^ number) % 65535 + 1

    pages = [bytearray(os.urandom(8192)) for _ in range(5)]
    for i in (0, 1, 2):
        pages[i][8:10] = reference(bytes(pages[i]), i).to_bytes(2, "little")
    pages[2][500] ^= 1
    pages[3][8:10] = b"\0\0"
    pages[4] = pages[4][:100]
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate(pages)], "path STRING, block_no BIGINT, data BINARY")
    assert [r["status"] for r in op.page_check(df).orderBy("block_no").collect()] == ["ok", "ok", "failed", "skipped", "skipped"]
    assert {r["status"] for r in op.page_check(df, mode="off").collect()} == {"skipped"}
    with pytest.raises(ValueError):
        op.page_check(df, mode="maybe")


def test_incremental_file_layout(spark):
    import struct

    from tidemark.sources import scan_incremental_files

    def body(numbers, limit, magic=0x494E4352):
        return struct.pack("<III", magic, len(numbers), limit) + struct.pack(f"<{len(numbers)}I", *numbers) + b"".join(bytes([n % 256]) * 8192 for n in numbers)

    rows = [("a", body([3, 4000000000], 7)), ("empty", body([], 0)), ("bad", body([1], 1, 0x11)), ("short", b"abc"), ("cut", body([1, 2], 1)[:-1])]
    blocks, limits, errors = scan_incremental_files(spark.createDataFrame(rows, "path STRING, content BINARY"))
    assert sorted((r["path"], r["block_no"], r["data"] == bytes([r["block_no"] % 256]) * 8192) for r in blocks.collect()) == [("a", 3, True), ("a", 4000000000, True)]
    assert {r["path"]: r["truncation_block_length"] for r in limits.collect()} == {"a": 7, "empty": 0}
    assert {r["path"]: r["error"] for r in errors.collect()} == {"bad": "bad marker", "short": "short header", "cut": "truncated"}


# --- resume ---------------------------------------------------------------

GATE = dict(tool_version="1", backup_type="full", compression="zstd", system_identifier=7, parent_backup_id=None, recipients=("a", "b"))
CHECKPOINT = (
    "backup_id STRING, tool_version STRING, backup_type STRING, parent_backup_id STRING, compression STRING,"
    " system_identifier DECIMAL(20,0), recipients ARRAY<STRING>, checkpointed_at TIMESTAMP"
)


def checkpoint(i, at=None, **changes):
    v = GATE | changes
    from decimal import Decimal

    return (i, v["tool_version"], v["backup_type"], v["parent_backup_id"], v["compression"], Decimal(v["system_identifier"]), list(v["recipients"]), at or day(0))


def resumable(spark, ids, checkpoints, grace=0, now=None, extra=()):
    objects = spark.createDataFrame([(f"{i}/backup_manifest.copy",) for i in ids] + [(p,) for p in extra], "path STRING")
    rows = op.find_resumable(objects, spark.createDataFrame(checkpoints, CHECKPOINT), op.Gate(**GATE), grace, now or day(0)).collect()
    return {r["backup_id"]: (r["action"], r["reason"]) for r in rows}


@pytest.mark.parametrize(
    "change",
    [dict(tool_version="2"), dict(backup_type="incremental"), dict(parent_backup_id="x"), dict(compression="gzip"), dict(system_identifier=8), dict(recipients=("b", "a"))],
)
def test_gate(spark, change):
    i = "20260101T000000F"
    assert resumable(spark, [i], [checkpoint(i, **change)])[i] == ("leave", "mismatch")


def test_resume_pick_and_reap(spark):
    a, b, c, d, done = (f"2026010{n}T000000F" for n in range(1, 6))
    got = resumable(
        spark, [a, b, c, d, done], [checkpoint(a), checkpoint(b), checkpoint(d, at=day(-2))], grace=86400, extra=[f"{done}/backup_manifest", "wal/backup_manifest.copy"]
    )
    assert got == {a: ("leave", "superseded"), b: ("resume", "newest"), c: ("reap", "corrupt"), d: ("reap", "expired")}
    assert resumable(spark, [a], [checkpoint(a, at=day(-30))]) == {a: ("resume", "newest")}


# --- snapshots and replay -------------------------------------------------


def test_incremental_snapshot_nulls(spark):
    schema = "k BIGINT, a STRING, b DOUBLE"
    old = spark.createDataFrame([(1, None, 1.0), (2, "x", None), (3, "y", 3.0), (4, "", 4.0)], schema)
    new = spark.createDataFrame([(1, None, 1.0), (2, "x", 2.0), (4, None, 4.0), (5, "n", None)], schema)
    want = {2: "U", 3: "D", 4: "U", 5: "I"}
    assert {r["k"]: r["op"] for r in op.incremental_snapshot(old, new, ["k"]).collect()} == want
    prints = old.select("k", op.row_fingerprint(["a", "b"]).alias("fingerprint"))
    inc1 = op.incremental_snapshot(prints, new, ["k"], fingerprints=True)
    assert {r["k"]: r["op"] for r in inc1.collect()} == want
    assert sorted(map(tuple, op.restore_chain(old, [inc1], ["k"]).collect())) == sorted(map(tuple, new.collect()))


def test_replay_hot_key_and_strings(spark):
    rng = random.Random(2)
    rows = [(0 if rng.random() < 0.5 else rng.randrange(1, 20), i, rng.choice("UUUD"), f"v{i}") for i in range(3000)]
    changes = spark.createDataFrame(rows, "k BIGINT, lsn BIGINT, op STRING, v STRING").repartition(5)
    base = spark.createDataFrame([(k, "base") for k in range(30)], "k BIGINT, v STRING")
    state = {k: "base" for k in range(30)}
    for k, lsn, o, v in rows:
        if lsn <= 2500:
            state.pop(k, None)
            if o == "U":
                state[k] = v
    got = op.replay_to_target(changes, Target(lsn=2500), ["k"], ["v"], base=base)
    assert {r["k"]: r["v"] for r in got.collect()} == state
    with pytest.raises(ValueError):
        op.replay_to_target(changes.withColumn("xid", F.lit(1)), Target(xid=99), ["k"], ["v"])


def test_unpublished_snapshot_is_invisible(spark, workdir):
    from tidemark.plans import backup_full, backup_incremental, restore_table, verify_snapshots
    from tidemark.plans import IdentityMismatch
    from tidemark.sources.store import SnapshotInfo, read_snapshot, snapshot_catalog, write_fan_out

    root = f"{workdir}/snap"
    df = spark.range(100).select("id", F.concat(F.lit("p"), "id").alias("v"))
    assert snapshot_catalog(spark, root).count() == 0
    backup_full(df, root, SnapshotInfo("A", server="s", system_identifier=7))
    df.write.parquet(f"{root}/half/data")
    assert [r["backup_id"] for r in snapshot_catalog(spark, root).collect()] == ["A"]
    with pytest.raises(LookupError):
        read_snapshot(spark, root, "half")
    with pytest.raises(Exception):
        backup_full(df, root, SnapshotInfo("A"))
    with pytest.raises(IdentityMismatch):
        backup_full(df, root, SnapshotInfo("B", server="s", system_identifier=8))
    more = df.where("id <> 5").unionByName(spark.range(100, 120).select("id", F.lit("new").alias("v")))
    backup_incremental(more, root, SnapshotInfo("I", "incremental", "A", "s", 7), ["id"])
    assert sorted(map(tuple, restore_table(spark, root, "I", ["id"]).collect())) == sorted(map(tuple, more.collect()))
    assert {r["status"] for r in verify_snapshots(spark, root).collect()} == {"OK"}
    import glob

    part = glob.glob(f"{root}/A/data/part-*")[0]
    with open(part, "r+b") as f:
        f.seek(10)
        f.write(b"\xff")
    assert {r["status"] for r in verify_snapshots(spark, root).collect()} == {"OK", "UNDECODABLE"}  # caught by the store's own sum
    import os

    crc = os.path.join(os.path.dirname(part), f".{os.path.basename(part)}.crc")
    os.rename(crc, crc + ".off")
    assert {r["status"] for r in verify_snapshots(spark, root).collect()} == {"OK", "MISMATCH"}
    with pytest.raises(RuntimeError):
        write_fan_out(df, {"x": root}, "A")


def test_annotation(spark):
    catalog = spark.createDataFrame([("a", "old"), ("b", "old"), ("c", None)], "backup_id STRING, annotation STRING")
    notes = spark.createDataFrame([("a", "new"), ("b", "")], "backup_id STRING, annotation STRING")
    assert {r["backup_id"]: r["annotation"] for r in op.update_annotation(catalog, notes).collect()} == {"a": "new", "b": None, "c": None}
    with pytest.raises(LookupError):
        op.update_annotation(catalog, spark.createDataFrame([("zz", "x")], "backup_id STRING, annotation STRING"))
