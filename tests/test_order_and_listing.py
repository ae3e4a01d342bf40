"""Sorted tables, listings of very large directories, chains in one job, timelines without a name."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark import operators as op
from tidemark.plans import repository as repo
from tidemark.sources import objects as obj
from tidemark.sources import read_sorted, write_sorted


@pytest.mark.parametrize("rows", [0, 1, 5000])
def test_positions_survive_a_round_trip(spark, workdir, rows):
    rng = random.Random(rows)
    data = [(rng.randrange(40) if rng.random() > 0.05 else None, f"{rng.random()}") for _ in range(rows)]
    df = spark.createDataFrame(data, "a INT, b STRING").repartition(5)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "300")
    try:
        write_sorted(df, f"{workdir}/t", [F.desc("a"), "b"])
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    got = read_sorted(spark, f"{workdir}/t").orderBy("position").collect()
    want = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [r["position"] for r in got] == list(range(rows)) and [(r["a"], r["b"]) for r in got] == want


def test_a_large_directory_is_listed_by_many_tasks(spark, workdir, monkeypatch):
    monkeypatch.setattr(obj, "NAMES_PER_TASK", 100)
    want = set()
    for folder, n in (("wal/00000001", 1500), ("deep/a/b", 30), ("deep/a", 250), ("", 20)):
        os.makedirs(f"{workdir}/{folder}", exist_ok=True)
        for i in range(n):
            name = f"{folder}/f{i}é".lstrip("/")
            with open(f"{workdir}/{name}", "w") as f:
                f.write("x" * (i % 7))
            want.add((name, i % 7))
    os.makedirs(f"{workdir}/deep/a/sub/one/two/three")
    with open(f"{workdir}/deep/a/sub/one/two/three/last", "w") as f:
        f.write("z")
    want.add(("deep/a/sub/one/two/three/last", 1))
    listed = [(r["path"], r["size"]) for r in obj.scan_objects(spark, workdir).collect()]
    assert sorted(listed) == sorted(w for w in want if not w[0].startswith("wal/"))
    wal = obj.scan_objects(spark, workdir, prefix="wal")
    found = wal.select("path", "size", F.spark_partition_id().alias("task")).collect()
    assert sorted((r["path"], r["size"]) for r in found) == sorted(w for w in want if w[0].startswith("wal/"))
    # The names of the one directory come from several tasks of the pass that listed it.
    shared = spark.createDataFrame([("wal/00000001", None, None, True, 0, 1)], "path STRING, size BIGINT, mod_time TIMESTAMP, folder BOOLEAN, share INT, shares INT")
    shares = shared.mapInArrow(obj._share(workdir, 100), shared.schema).collect()
    assert sorted((r["share"], r["shares"]) for r in shares) == [(i, 15) for i in range(15)]


class Counting:
    """Counts the jobs a table is asked for."""

    def __init__(self, df):
        self.df, self.jobs = df, 0
        self.sparkSession, self.schema = df.sparkSession, df.schema

    def where(self, condition):
        self.jobs += 1
        return self.df.where(condition)


def test_a_chain_of_any_length_is_one_job(spark):
    ids = ["20260101T000000F"]
    for n in range(40):
        ids.append(f"{ids[-1]}_202602{n:02}T000000I")
    rows = [(b, "incremental" if i else "full", ids[i - 1] if i else None) for i, b in enumerate(ids)] + [("other", "full", None)]
    table = Counting(spark.createDataFrame(rows, "backup_id STRING, type STRING, parent_backup_id STRING"))
    got = repo.chain_members(table, ids[-1]).orderBy("seq").collect()
    assert [r["backup_id"] for r in got] == ids and table.jobs == 1


def test_pointers_decide_where_ids_do_not(spark):
    rows = [("root", "full", None), ("root_x_mid", "incremental", "root"), ("tip", "incremental", "root_x_mid"), ("lost_a", "incremental", "lost"), ("a", "incremental", "b"), ("b", "incremental", "a")]
    table = spark.createDataFrame(rows, "backup_id STRING, type STRING, parent_backup_id STRING")
    assert [r["backup_id"] for r in repo.chain_members(table, "tip").orderBy("seq").collect()] == ["root", "root_x_mid", "tip"]
    for broken in ("lost_a", "a", "none"):
        with pytest.raises(LookupError):
            repo.chain_members(table, broken)


def test_a_timeline_without_a_name_is_one_of_its_own(spark):
    rows = [(None, 0, 10), (None, 20, 30), (None, 5, 12), (1, 0, 30), (None, None, 5)]
    df = spark.createDataFrame(rows, "tli BIGINT, start_lsn BIGINT, end_lsn BIGINT")
    for bucket in (1, 2, 100):
        assert [tuple(r) for r in op.summary_gaps(df, bucket=bucket).collect()] == [(None, 12, 20)]
        bounded = sorted(map(str, map(tuple, op.summary_gaps(df, 0, 40, bucket).collect())))
        assert bounded == ["(1, 30, 40)", "(None, 12, 20)", "(None, 30, 40)"]
    assert sorted(map(str, map(tuple, op.summary_gaps(df, 50, 60).collect()))) == ["(1, 50, 60)", "(None, 50, 60)"]


def test_one_timeline_is_cut_into_even_ranges(spark):
    df = spark.range(4000).selectExpr("1L AS tli", "CASE WHEN id % 2 = 0 THEN id * 3 ELSE (1L << 50) + id * 3 END AS start_lsn").selectExpr("tli", "start_lsn", "start_lsn + 2 AS end_lsn")
    gaps = op.summary_gaps(df, bucket=500)
    assert gaps.count() == 3999
    sizes = []
    real = op.blocks.materialize
    try:
        op.blocks.materialize = lambda rows: sizes.append(rows) or real(rows)
        op.summary_gaps(df, bucket=500)
    finally:
        op.blocks.materialize = real
    counts = [r["count"] for r in sizes[-1].groupBy("_b").count().collect()]
    assert len(counts) == 8 and max(counts) < 1000


def test_the_tree_of_documents_is_written_by_tasks_without_a_commit(spark):
    import os

    from workload.log_queries import _stored_documents
    from workload.views import S

    root, listing = _stored_documents(S(spark, "/root/testdata/sf0.001"))
    assert not os.path.exists(f"{root.removeprefix('file:')}/_SUCCESS")
    assert listing.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
