"""Streams fed by several files, so that state crosses micro-batches."""

from datetime import timedelta

from tests.builder import day
from tidemark.sources.store import read_archive
from tidemark.streaming import (
    archive_lag,
    fan_out_stream,
    ingest_stream,
    progress_stream,
    read_progress,
    replica_liveness,
    watch_required,
)

SEGMENT = "tli BIGINT, name STRING, sha256 STRING, size BIGINT, seg_no BIGINT"


def feed(spark, workdir, name, schema, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{workdir}/{name}/{i:03}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{workdir}/{name}")


def drain(writer, workdir, name):
    job = writer.option("checkpointLocation", f"{workdir}/cp-{name}").trigger(availableNow=True).start()
    job.awaitTermination()


def table(spark, stream, workdir, name):
    drain(stream.writeStream.format("parquet").option("path", f"{workdir}/out-{name}"), workdir, name)
    return spark.read.schema(stream.schema).parquet(f"{workdir}/out-{name}").collect()


def test_ingest(spark, workdir):
    batches = [
        [(1, "A", "x", 5, 10)] * 8,
        [(1, "A", "x", 5, 10), (1, "B", "y", 5, 11)],
        [(1, "A", "z", 5, 10), (1, "C", "c", 5, 12), (1, "OLD", "o", 5, 1)],
    ]
    stream = feed(spark, workdir, "in", SEGMENT, batches)
    for _ in range(2):  # the second start finds nothing new
        drain(ingest_stream(stream, f"{workdir}/archive", f"{workdir}/side", low_water_seg=5), workdir, "ingest")
    assert sorted((r["name"], r["sha256"]) for r in read_archive(spark, f"{workdir}/archive").collect()) == [("A", "x"), ("B", "y"), ("C", "c")]
    assert [(r["name"], r["sha256"]) for r in spark.read.parquet(f"{workdir}/side/conflicts").collect()] == [("A", "z")]
    assert [r["name"] for r in spark.read.parquet(f"{workdir}/side/late").collect()] == ["OLD"]


def test_watch_required(spark, workdir):
    t = [day(0) + timedelta(minutes=m) for m in range(200)]
    required = spark.createDataFrame(
        [("full", 1, n, t[20]) for n in (3, 4, 5)] + [("late", 1, n, t[20]) for n in (7, 8, 9)] + [("open", 1, 99, t[190])],
        "backup_id STRING, tli BIGINT, seg_no BIGINT, deadline TIMESTAMP",
    )
    batches = [
        [(1, 3, t[1]), (1, 7, t[1]), (1, 3, t[2])],
        [(1, 4, t[5]), (2, 5, t[5])],
        [(1, 5, t[20]), (1, 9, t[21])],
        [(1, 8, t[100])],
    ]
    arrivals = feed(spark, workdir, "arr", "tli BIGINT, seg_no BIGINT, ts TIMESTAMP", batches)
    got = table(spark, watch_required(required, arrivals), workdir, "watch")
    assert sorted((r["backup_id"], r["status"], r["seg_no"]) for r in got) == [
        ("full", "complete", None), ("late", "timeout", 8), ("late", "timeout", 9)
    ]


def test_watch_required_in_pieces(spark, workdir):
    """Backups over several pieces, one that needs nothing, one whose need is unknown."""
    t = [day(0) + timedelta(minutes=m) for m in range(200)]
    step = 5000
    required = spark.createDataFrame(
        [("wide", 1, n, t[50]) for n in range(0, 100_000, step)] + [("hole", 2, n, t[50]) for n in range(0, 100_000, step)] + [("unknown", None, None, t[40])],
        "backup_id STRING, tli BIGINT, seg_no BIGINT, deadline TIMESTAMP",
    )
    backups = spark.createDataFrame([("wide",), ("hole",), ("nothing",), ("nothing",)], "backup_id STRING")
    every = list(range(0, 100_000, step))
    batches = [
        [(1, n, t[1]) for n in every[:9]] + [(2, n, t[1]) for n in every[1:]],
        [(1, n, t[2]) for n in every[9:]] + [(2, 0, t[60])],
        [(9, None, t[199])],  # matches nothing, but time moves
    ]
    arrivals = feed(spark, workdir, "arr", "tli BIGINT, seg_no BIGINT, ts TIMESTAMP", batches)
    got = table(spark, watch_required(required, arrivals, backups=backups), workdir, "pieces")
    assert sorted(tuple(map(str, (r["backup_id"], r["status"], r["tli"], r["seg_no"]))) for r in got) == [
        ("hole", "timeout", "2", "0"), ("nothing", "complete", "None", "None"), ("unknown", "timeout", "None", "None"), ("wide", "complete", "None", "None")
    ]


def test_progress_in_groups(spark, workdir):
    sizes = [3, 0, 5, 1, 9, 2]
    rows, n = [], 0
    for k in sizes:
        rows.append([(f"p{(n + i):03}", n + i) for i in reversed(range(k))])
        n += k
    files = feed(spark, workdir, "f", "path STRING, size BIGINT", [r or [("empty", -1)] for r in rows])
    seen = []
    drain(progress_stream(files.where("size >= 0"), lambda b, i: seen.append((i, b.count())), f"{workdir}/progress", every=4), workdir, "p")
    got = {r["path"]: r["batch"] for r in read_progress(spark, f"{workdir}/progress", "path STRING, size BIGINT").collect()}
    total, want = 0, {}
    for batch, k in enumerate(sizes):
        total += k
        for i in range(total // 4 * 4):
            want.setdefault(f"p{i:03}", batch)
    assert got == want and sum(c for _, c in seen) == 20


def test_a_repeated_step_records_the_same(spark, workdir):
    from tidemark.streaming import ingest

    recorded = {}

    class Writer:
        def foreachBatch(self, step):
            recorded["step"] = step

    class Files:
        writeStream = Writer()

    ingest.progress_stream(Files(), lambda b, i: None, f"{workdir}/p", every=3)
    frame = lambda *names: spark.createDataFrame([(n,) for n in names], "path STRING")
    steps = [frame("a", "b"), frame("c", "c", "c", "d"), frame("e")]
    for k in (0, 0, 1, 1, 2, 2):
        recorded["step"](steps[k], k)
    got = sorted((r["path"], r["batch"]) for r in read_progress(spark, f"{workdir}/p", "path STRING").collect())
    assert got == [("a", 1), ("b", 1), ("c", 1), ("c", 1), ("c", 1), ("d", 1)]


def test_archive_lag(spark, workdir):
    t = [day(0) + timedelta(minutes=m) for m in range(400)]
    markers = feed(spark, workdir, "m", "marker_id BIGINT, tli BIGINT, name STRING, ts TIMESTAMP", [[(1, 1, "A", t[0]), (2, 1, "B", t[1]), (3, 1, "C", t[2])], [(4, 1, "D", t[300])], [(5, 1, "E", t[301])]])
    arrivals = feed(spark, workdir, "a", "tli BIGINT, name STRING, ts TIMESTAMP", [[(1, "A", t[3])], [(1, "B", t[9])], [(1, "Z", t[320])]])
    got = {r["marker_id"]: r["reached"] for r in table(spark, archive_lag(markers, arrivals, "5 minutes"), workdir, "lag")}
    assert got[1] is True and got[2] is False and got[3] is False


def test_liveness(spark, workdir):
    schema = "host STRING, ts TIMESTAMP, in_recovery BOOLEAN, replay_lsn STRING, receivers INT, restore_command STRING"
    rows = [
        ("primary", day(0), False, None, 0, None), ("streaming", day(0), True, "0/1", 1, ""), ("archive", day(0), True, "0/1", 0, "cp"),
        ("alone", day(0), True, "0/1", 0, ""), ("silent", day(0), True, "", 1, "cp"),
        ("flips", day(0), True, "0/1", 1, ""), ("flips", day(1), True, "0/2", 0, ""),
    ]
    want = {"primary": True, "streaming": True, "archive": True, "alone": False, "silent": False, "flips": False}
    assert {r["host"]: r["ok"] for r in replica_liveness(spark.createDataFrame(rows, schema)).collect()} == want
    stream = feed(spark, workdir, "s", schema, [rows[:6], rows[6:]])
    seen = {}

    def keep(batch, _):
        seen.update({r["host"]: r["ok"] for r in batch.collect()})

    drain(replica_liveness(stream).writeStream.outputMode("update").foreachBatch(keep), workdir, "live")
    assert seen == want


def test_progress(spark, workdir):
    files = feed(spark, workdir, "f", "path STRING, size BIGINT", [[(f"p{i}", i)] for i in range(4)])
    done = []
    drain(progress_stream(files, lambda b, i: done.append(b.count()), f"{workdir}/progress"), workdir, "p1")
    assert done == [1, 1, 1, 1]
    assert read_progress(spark, f"{workdir}/progress", "path STRING, size BIGINT").count() == 4
    blocked = f"{workdir}/blocked"
    open(blocked, "w").write("a file where a folder should be")
    done.clear()
    drain(progress_stream(files, lambda b, i: done.append(b.count()), f"{blocked}/x"), workdir, "p2")
    assert done == [1, 1, 1, 1]


def test_fan_out(spark, workdir):
    import pytest

    rows = feed(spark, workdir, "r", "id BIGINT", [[(1,)], [(2,), (3,)]])
    blocked = f"{workdir}/blocked"
    open(blocked, "w").write("a file where a folder should be")
    targets = {"a": f"{workdir}/a", "bad": f"{blocked}/x", "c": f"{workdir}/c"}
    drain(fan_out_stream(rows, targets, f"{workdir}/status"), workdir, "fan")
    for t in "ac":
        assert sorted(r["id"] for r in spark.read.parquet(targets[t]).collect()) == [1, 2, 3]
    got = spark.read.parquet(f"{workdir}/status").collect()
    assert sorted((r["batch"], r["target"], r["status"]) for r in got) == [
        (0, "a", "committed"), (0, "bad", "failed"), (0, "c", "committed"), (1, "a", "committed"), (1, "c", "committed")
    ]
    with pytest.raises(Exception, match="no target is left"):
        drain(fan_out_stream(rows, {"bad": f"{blocked}/x"}, f"{workdir}/status2"), workdir, "fan2")


def test_snapshot_resumes_after_a_crash(spark, workdir):
    import os

    from pyspark.sql import functions as F

    from tidemark.plans import backup_resumable, resume_state
    from tidemark.sources.store import SnapshotInfo, read_snapshot, snapshot_catalog

    root, info = f"{workdir}/snap", SnapshotInfo("A")
    df = spark.range(1000).select("id", F.concat(F.lit("p"), F.col("id") % 10).alias("part"))
    real = os.rename

    # The run dies before its manifest: progress and data stay behind.
    backup_resumable(df, root, info, "part", steps=4, settings="v1")
    real(f"{root}/A/manifest", f"{workdir}/manifest-lost")
    assert snapshot_catalog(spark, root).count() == 0
    before = {d: os.stat(f"{root}/A/data/{d}").st_mtime_ns for d in os.listdir(f"{root}/A/data") if d.startswith("_step")}
    changed = df.withColumn("id", F.when(F.col("part") == "p3", F.col("id") + 5000).otherwise(F.col("id")))
    status = {r["path"]: r["status"] for r in resume_state(changed, root, info, "part", "v1")[1].collect()}
    assert status == {f"p{i}": "source_changed" if i == 3 else "reusable" for i in range(10)}
    assert resume_state(df, root, info, "part", "v2")[1].count() == 0
    totals = backup_resumable(changed, root, info, "part", steps=4, settings="v1").first()
    assert (totals["files"], totals["bytes"]) == (10, 1000)
    after = {d: os.stat(f"{root}/A/data/{d}").st_mtime_ns for d in before}
    assert sum(before[d] != after[d] for d in before) == 1
    assert sorted(map(tuple, read_snapshot(spark, root, "A").collect())) == sorted(map(tuple, changed.collect()))


def test_streams_read_tables_that_are_folders(spark, workdir):
    import __spark_entry__ as entry

    small = "/root/testdata/sf0.001"
    for table in ("documents", "events"):
        spark.read.parquet(f"{small}/{table}.parquet").repartition(3).write.parquet(f"{workdir}/{table}.parquet")
    for name in ("stream_progress", "stream_fan_out"):
        assert sorted(entry.queries()[name](spark, workdir).collect()) == sorted(entry.queries()[name](spark, small).collect())


def test_watched_backups_share_the_keys_of_the_state(spark, workdir):
    """Sixty backups with deadlines of their own, every third over two pieces, in four keys of state."""
    t = [day(0) + timedelta(minutes=m) for m in range(300)]
    need = {b: [b * 10, b * 10 + 1, b * 10 + 2 + (1 << 20 if b % 3 == 0 else 0)] for b in range(60)}
    required = spark.createDataFrame([(b, 1, n, t[50 + b]) for b, ns in need.items() for n in ns], "backup_id BIGINT, tli BIGINT, seg_no BIGINT, deadline TIMESTAMP")
    backups = spark.createDataFrame([(b,) for b in [*need, 70, 71]], "backup_id BIGINT")
    late = {b: ns[-1] for b, ns in need.items() if b % 5 == 0}
    batches = [
        [(1, ns[0], t[1]) for ns in need.values()],
        [(1, n, t[2]) for b, ns in need.items() for n in ns[1:] if late.get(b) != n],
        [(1, n, t[51 + b]) for b, n in late.items() if b < 20],
        [(9, 0, t[80])],
        [(1, late[55], t[90]), (9, 0, t[250])],
    ]
    arrivals = feed(spark, workdir, "arr", "tli BIGINT, seg_no BIGINT, ts TIMESTAMP", batches)
    out = watch_required(required, arrivals, backups=backups, shelves=4)
    job = out.writeStream.format("parquet").option("path", f"{workdir}/out").option("checkpointLocation", f"{workdir}/cp").trigger(availableNow=True).start()
    job.awaitTermination()
    got = [tuple(r) for r in spark.read.schema(out.schema).parquet(f"{workdir}/out").collect()]
    missed = {b: n for b, n in late.items() if b != 55}
    want = [(b, "timeout", 1, n) for b, n in missed.items()] + [(b, "complete", None, None) for b in [*need, 70, 71] if b not in missed]
    assert sorted(got, key=str) == sorted(want, key=str)
    # A key holds its value and at most a timer in two orders.
    assert all(s["numRowsTotal"] <= 4 * 3 for p in job.recentProgress for s in p["stateOperators"])
