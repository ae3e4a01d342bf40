"""Inputs that used to lose rows, or whole jobs, without a word."""

import os

from pyspark.sql import functions as F

from tidemark import operators as op
from tidemark.functions.lsn import parse_lsn
from tidemark.functions.targets import Target
from tidemark.plans.resumable import part_prints
from tidemark.sources.metadata import manifest_headers, manifest_warnings
from tidemark.sources.objects import filter_source_tree, scan_objects, split_deep
from tidemark.sources.store import archive_ingest, read_archive

SEGMENTS = "tli BIGINT, name STRING, sha256 STRING, size BIGINT, at BIGINT"


def stored(spark, archive):
    return sorted((r["name"], r["sha256"]) for r in read_archive(spark, archive).collect())


def test_deep_paths_stay_unless_a_bound_is_given(spark):
    deep = "/".join("abcdefghijklm")
    rows = spark.createDataFrame([(deep,), ("a/b",)], "path STRING")
    assert filter_source_tree(rows).count() == 2
    assert [r["path"] for r in filter_source_tree(rows, max_depth=12).collect()] == ["a/b"]
    assert [(r["path"], r["error"]) for r in split_deep(rows, 12)[1].collect()] == [(deep, "path too deep")]


def test_two_pushers_with_one_batch_id(spark, workdir):
    archive = f"{workdir}/archive"
    pushes = [spark.createDataFrame([(1, n, n.lower(), 1, 0)], SEGMENTS) for n in ("A", "B")]
    for push in (*pushes, pushes[0]):
        archive_ingest(push, archive, "0")
    assert stored(spark, archive) == [("A", "a"), ("B", "b")]


def test_first_content_stays_however_batches_are_cut(spark, workdir):
    rows = [(1, "A", "z", 1, 1), (1, "A", "b", 1, 2), (1, "B", "y", 1, 3), (1, "B", "x", 1, 3), (1, "A", "z", 1, 4)]
    for number, cut in enumerate(([rows], [rows[:1], rows[1:]], [rows[:2], rows[2:]], [rows[:4], rows[4:]])):
        archive = f"{workdir}/archive{number}"
        for k, part in enumerate(cut):
            verdict = archive_ingest(spark.createDataFrame(part, SEGMENTS), archive, str(k), arrived="at")
        assert stored(spark, archive) == [("A", "z"), ("B", "x")]
    assert {(r["name"], r["sha256"]): r["status"] for r in verdict.collect()} == {("A", "z"): "duplicate"}


def test_window_outside_all_summaries(spark):
    rows = spark.createDataFrame([(1, 0, 10), (2, 90, 150)], "tli BIGINT, start_lsn BIGINT, end_lsn BIGINT")
    assert sorted(map(tuple, op.summary_gaps(rows, 100, 200).collect())) == [(1, 100, 200), (2, 150, 200)]


def test_newest_increment_keeps_its_own_blocks(spark):
    blocks = spark.createDataFrame([("f", 0, 7, "old"), ("f", 0, 0, "old"), ("f", 1, 7, "new"), ("f", 1, 8, "new")], "path STRING, chain_pos INT, block_no BIGINT, value STRING")
    limits = spark.createDataFrame([("f", 1, 1)], "path STRING, chain_pos INT, truncation_block_length BIGINT")
    got = {(r["block_no"], r["value"]) for r in op.combine_chain(blocks, limits).collect()}
    assert got == {(0, "old"), (7, "new"), (8, "new")}


def test_unknown_positions_are_missing(spark):
    backups = spark.createDataFrame([("a", 1, None, 5), ("b", None, 0, 5), ("c", 1, 0, 5), ("d", 1, 9, 5)], "backup_id STRING, timeline BIGINT, start_lsn BIGINT, stop_lsn BIGINT")
    archive = spark.createDataFrame([(1, 0, "segment")], "tli BIGINT, seg_no BIGINT, kind STRING")
    missing = op.missing_segments(op.required_segments(backups), archive).collect()
    assert sorted((r["backup_id"], r["seg_no"]) for r in missing) == [("a", None), ("b", None)]


def test_a_column_called_fingerprint_is_a_value(spark):
    rows = spark.createDataFrame([(1, "x", "y")], "k INT, fingerprint STRING, v STRING")
    assert op.incremental_snapshot(rows, rows, ["k"]).count() == 0
    assert op.incremental_snapshot(rows, rows.drop("fingerprint"), ["k"], columns=["v"]).count() == 0


def test_a_null_that_moves_changes_the_print(spark):
    make = lambda *row: part_prints(spark.createDataFrame([("p", *row)], "part STRING, a STRING, b STRING, c ARRAY<STRING>"), "part").first()["sha256"]
    prints = {make("x", None, None), make(None, "x", None), make(None, None, ["x"]), make(None, None, [None, "x"]), make(None, None, ["x", None])}
    assert len(prints) == 5


def test_overflowed_position_is_a_warning(spark):
    ranges = "array(named_struct('Timeline', 1L, 'Start-LSN', '{}', 'End-LSN', '0/2'))"
    rows = spark.range(1).selectExpr("'b' AS backup_id", "true AS readable", "cast(array() AS array<struct<Path:string,Size:bigint,`Last-Modified`:string,Checksum:string,Incremental:boolean>>) AS files", ranges.format("FFFFFFFF/0") + " AS ranges")
    row = manifest_headers(rows).first()
    assert row["start_lsn"] is None and row["stop_lsn"] == 2
    assert [r["backup_id"] for r in manifest_warnings(rows).collect()] == ["b"]
    good = rows.withColumn("ranges", F.expr(ranges.format("0/1")))
    assert manifest_warnings(good).count() == 0 and good.select(parse_lsn(F.lit("0/1"))).first()[0] == 1


def test_links_are_not_followed(spark, workdir):
    os.makedirs(f"{workdir}/a/b")
    open(f"{workdir}/a/b/file", "w").close()
    os.symlink(workdir, f"{workdir}/a/b/up")
    os.symlink(f"{workdir}/a", f"{workdir}/twice")
    assert [r["path"] for r in scan_objects(spark, workdir).collect()] == ["a/b/file"]


def test_null_operation_writes(spark):
    changes = spark.createDataFrame([(1, None, 1, "v"), (2, "D", 2, None)], "k INT, op STRING, lsn BIGINT, value STRING")
    base = spark.createDataFrame([(1, "old"), (2, "old"), (3, "old")], "k INT, value STRING")
    got = op.replay_to_target(changes, Target(), ["k"], ["value"], base)
    assert sorted(map(tuple, got.collect())) == [(1, "v"), (3, "old")]


def test_unreachable_store_fails_its_probe(spark):
    backups = spark.createDataFrame([], "backup_id STRING, type STRING, parent_backup_id STRING")
    empty = spark.createDataFrame([], "path STRING")
    report = op.health_report(empty, backups, empty, empty, unreachable="permission denied").collect()
    assert [(r["ok"], r["detail"]) for r in report if r["name"] == "storage_reachable"] == [(False, "permission denied")]
    assert not any(r["all_ok"] for r in report)


def test_dropped_target_stays_dropped_after_a_restart(spark, workdir):
    from tidemark.schemas import REPLICAS
    from tidemark.streaming.ingest import fan_out_stream

    spark.range(5).write.parquet(f"{workdir}/in")
    spark.createDataFrame([("b", "0", "data", "failed", "gone")], REPLICAS).write.parquet(f"{workdir}/status/batch=0")
    rows = spark.readStream.schema("id BIGINT").parquet(f"{workdir}/in")
    writer = fan_out_stream(rows, {"a": f"{workdir}/a", "b": f"{workdir}/b"}, f"{workdir}/status")
    writer.option("checkpointLocation", f"{workdir}/cp").trigger(availableNow=True).start().awaitTermination()
    assert os.path.isdir(f"{workdir}/a") and not os.path.exists(f"{workdir}/b")


def test_decoded_bodies_leave_in_batches_of_bounded_bytes(spark):
    import pyarrow as pa

    from tidemark.sources import decode_contents

    class Contents:
        schema = spark.createDataFrame([], "id BIGINT, codec STRING, content BINARY").schema

        def mapInArrow(self, run, schema):
            return run

    bodies = [b"x" * (1 << 20)] * 40 + [None, b"bad"]
    batch = pa.RecordBatch.from_pydict({"id": list(range(42)), "codec": ["none"] * 41 + ["gzip"], "content": pa.array(bodies, pa.binary())})
    out = list(decode_contents(Contents())(iter([batch])))
    assert max(b.nbytes for b in out) < 5 << 20
    whole = pa.Table.from_batches(out).to_pydict()
    assert whole["id"] == list(range(42)) and whole["content"] == bodies[:41] + [None]
    assert whole["error"][:41] == [None] * 41 and whole["error"][41].startswith("decompress")
