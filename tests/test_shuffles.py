"""Pairs and numbers of which there are far more than rows are not shuffled."""

import pytest
from pyspark.sql import functions as F

from tidemark import operators as op


@pytest.fixture
def shuffled(spark):
    """Records written to shuffles while a function runs."""
    store, new = spark._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList

    def total():
        stages = store.stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), new())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    def run(action):
        before = total()
        result = action()
        return result, total() - before

    return run


def test_long_windows_shuffle_changes_not_pairs(spark, shuffled):
    changed = spark.range(2000).select(F.lit(1).cast("bigint").alias("tli"), F.lit(1).alias("rel"), F.lit(0).alias("fork"), (F.col("id") % 1500).alias("block_no"), (F.col("id") * 10).alias("lsn"))
    windows = spark.range(100).select("id", F.lit(1).cast("bigint").alias("tli"), F.col("id").alias("start_lsn"), F.lit(1 << 62).alias("end_lsn")).withColumnRenamed("id", "window_id")
    found = op.changed_in_windows(changed, windows, bucket=512)
    counts, records = shuffled(lambda: [r[1] for r in found.groupBy("window_id").count().collect()])
    # Windows that begin past the change at 0, of a block changed again, still hold it.
    assert sorted(counts) == [1500] * 100
    assert records < 20_000


def test_windows_under_one_id_find_a_block_once(spark):
    changed = spark.createDataFrame([(1, 1, 0, 5, lsn) for lsn in (3, 30, 30, 700)], "tli BIGINT, rel INT, fork INT, block_no INT, lsn BIGINT")
    windows = spark.createDataFrame([(7, 1, 0, 40), (7, 1, 20, 900), (8, 1, 4, 31)], "window_id INT, tli BIGINT, start_lsn BIGINT, end_lsn BIGINT")
    assert sorted(op.changed_in_windows(changed, windows, bucket=16).select("window_id", "block_no").collect()) == [(7, 5), (8, 5)]


def test_filled_chain_shuffles_runs_not_numbers(spark, shuffled):
    blocks = spark.createDataFrame([("a", 5, 1, 1.0), ("a", 99_999, 2, 2.0), ("b", 0, 2, 3.0), ("b", 200_000, 2, 4.0)], "path STRING, block_no BIGINT, chain_pos INT, value DOUBLE")
    limits = spark.createDataFrame([("a", 2, 100_000), ("b", 2, 50_000), ("c", 2, 3), ("d", 2, 0)], "path STRING, chain_pos INT, truncation_block_length BIGINT")
    filled = op.combine_chain(blocks, limits, base_pos=1, fill=True, chunk=512)

    found = filled.groupBy("path").agg(F.count(F.lit(1)), F.count("value"), F.count_distinct("block_no")).collect()
    assert sorted(map(tuple, found)) == [("a", 100_000, 2, 100_000), ("b", 50_001, 2, 50_001), ("c", 3, 0, 3)]
    _, records = shuffled(lambda: op.combine_chain(blocks, limits, base_pos=1, fill=True, chunk=512).groupBy("path").count().collect())
    assert records < 2_000


def test_missing_runs_of_long_ranges_are_spread_over_tasks(spark):
    segments = spark.range(0, 60_000, 3).select(F.lit(1).cast("bigint").alias("tli"), F.lit("segment").alias("kind"), F.col("id").alias("seg_no"))
    backups = spark.range(20).select(F.col("id").alias("backup_id"), F.lit(1).cast("bigint").alias("timeline"), (F.col("id") * 3 * (16 << 20)).alias("start_lsn"), F.lit(1 << 62).alias("stop_lsn"))
    found = op.missing_runs(backups, segments)
    got = found.groupBy("backup_id", F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"), F.min("from_seg").alias("lo")).collect()
    rows, lowest, load = {}, {}, {}
    for r in got:
        rows[r["backup_id"]] = rows.get(r["backup_id"], 0) + r["n"]
        lowest[r["backup_id"]] = min(lowest.get(r["backup_id"], 1 << 62), r["lo"])
        load[r["task"]] = load.get(r["task"], 0) + r["n"]
    assert rows == {i: 20_000 - i for i in range(20)} and lowest == {i: 3 * i + 1 for i in range(20)}
    assert max(load.values()) < sum(load.values()) / 4


def test_summary_gaps_takes_tasks_by_cores_not_by_rows(spark):
    rows = spark.range(3000).select((F.col("id") % 2).alias("tli"), (F.col("id") * 10).alias("start_lsn"), (F.col("id") * 10 + F.when(F.col("id") % 5 == 0, 15).otherwise(25)).alias("end_lsn"))
    sc = spark.sparkContext
    sc.setJobGroup("gaps", "")
    try:
        gaps = sorted(map(tuple, op.summary_gaps(rows, bucket=10).collect()))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert gaps == [(i % 2, i * 10 + 15, i * 10 + 20) for i in sorted(range(0, 2998, 5), key=lambda i: (i % 2, i))]
    tracker = sc.statusTracker()
    stages = [tracker.getStageInfo(s) for job in tracker.getJobIdsForGroup("gaps") for s in tracker.getJobInfo(job).stageIds]
    assert max(s.numTasks for s in stages if s is not None) <= 8 * sc.defaultParallelism


def test_chain_with_runs_of_holes_writes_no_numbers(spark):
    blocks = spark.createDataFrame([("a", 5, 1, 1.0), ("a", 7, 2, 2.0), ("b", 0, 2, 3.0), ("b", 1 << 41, 2, 4.0)], "path STRING, block_no BIGINT, chain_pos INT, value DOUBLE")
    limits = spark.createDataFrame([("a", 2, 10), ("b", 2, 1 << 40), ("c", 2, 3), ("d", 2, 0)], "path STRING, chain_pos INT, truncation_block_length BIGINT")
    found = op.combine_chain_runs(blocks, limits, base_pos=1).select("path", "block_no", "n_blocks", "value", "chain_pos").collect()
    want = [("a", 0, 5, None, None), ("a", 5, 1, 1.0, 1), ("a", 6, 1, None, None), ("a", 7, 1, 2.0, 2), ("a", 8, 2, None, None)]
    want += [("b", 0, 1, 3.0, 2), ("b", 1, (1 << 40) - 1, None, None), ("b", 1 << 41, 1, 4.0, 2), ("c", 0, 3, None, None)]
    assert sorted(map(tuple, found), key=lambda r: r[:2]) == want
    # The same blocks as the filled chain, where that can be written out.
    small = limits.where("path <> 'b'")
    numbers = op.combine_chain_runs(blocks, small, base_pos=1).select("path", F.explode(F.sequence(F.col("block_no"), F.col("block_no") + F.col("n_blocks") - 1)).alias("block_no"), "value", "chain_pos")
    filled = op.combine_chain(blocks, small, base_pos=1, fill=True)
    assert sorted(map(str, numbers.collect())) == sorted(map(str, filled.select(*numbers.columns).collect()))


@pytest.mark.parametrize("broadcast", [True, False])
def test_missing_runs_shuffle_gaps_and_ranges_not_pairs(spark, shuffled, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(op.intervals, "bounded_broadcast", lambda df: df)
    segments = spark.range(0, 2_000_000, 20_000).select(F.lit(1).cast("bigint").alias("tli"), F.lit("segment").alias("kind"), F.col("id").alias("seg_no"))
    backups = spark.range(500).select(F.col("id").alias("backup_id"), F.lit(1).cast("bigint").alias("timeline"), (F.col("id") * (16 << 20)).alias("start_lsn"), F.lit(1 << 62).alias("stop_lsn"))
    counts, records = shuffled(lambda: [r[1] for r in op.missing_runs(backups, segments).groupBy("backup_id").count().collect()])
    assert counts == [100] * 500
    # Before, each range was shuffled with each of 122 stretches.
    assert records < (20_000 if broadcast else 500 * 60 * 16)
