"""Chains of stored files: pages are read last, and only those that win."""

import gzip
import os
import re
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.operators import combine_chain
from tidemark.sources import combine_files, fetch_pages, scan_page_index

FILES = "path STRING, chain_pos INT, location STRING, codec STRING, size BIGINT"
SIZE = 16


def page(c):
    return bytes([c]) * SIZE


def increment(pages, limit, magic=0x494E4352):
    return struct.pack("<III", magic, len(pages), limit) + b"".join(struct.pack("<I", n) for n, _ in pages) + b"".join(p for _, p in pages)


@pytest.fixture
def chain(spark, workdir):
    rows = []

    def put(pos, path, body, codec="none", size=None):
        location = f"{pos}/{path}"
        os.makedirs(os.path.dirname(f"{workdir}/{location}"), exist_ok=True)
        with open(f"{workdir}/{location}", "wb") as f:
            f.write(gzip.compress(body) if codec == "gzip" else body)
        rows.append((path, pos, location, codec, len(body) if size is None else size))

    put(0, "a/1", b"".join(page(i) for i in range(9)) + b"end", "gzip")
    put(0, "a/2", page(7))
    put(0, "empty", b"")
    put(1, "a/INCREMENTAL.1", increment([(8, page(18)), (2, page(12)), (4, page(14))], 20), "gzip")
    put(2, "a/INCREMENTAL.1", increment([(2, page(22)), (30, page(23))], 6))
    put(1, "INCREMENTAL.new", increment([(0, page(1))], 1))
    put(1, "short/INCREMENTAL.x", b"abc")
    put(1, "bad/INCREMENTAL.x", increment([], 1, magic=5))
    put(1, "cut/INCREMENTAL.x", increment([(0, page(1)), (1, page(1))], 1)[:-1])
    put(1, "codec/INCREMENTAL.x", increment([], 1), "none")
    rows[-1] = (*rows[-1][:3], "rar", 12)
    rows.append(("gone/INCREMENTAL.x", 1, "nowhere", "none", 40))
    return spark.createDataFrame(rows, FILES)


def test_chain_of_files_equals_the_merge_of_rows(spark, workdir, chain):
    pages, errors = combine_files(chain, workdir, size=SIZE)
    got = {(r["path"], r["block_no"]): (r["chain_pos"], r["data"]) for r in pages.collect()}
    want = {("a/1", b): (0, page(b)) for b in range(6)} | {("a/1", 2): (2, page(22)), ("a/1", 30): (2, page(23)), ("a/1", 4): (1, page(14))}
    want |= {("a/2", 0): (0, page(7)), ("new", 0): (1, page(1))}
    assert got == want
    assert {(r["path"], r["error"]) for r in errors.collect()} == {
        ("short/x", "short header"), ("bad/x", "bad marker"), ("cut/x", "truncated"), ("codec/x", "unknown codec rar"), ("gone/x", "not found")
    }


def test_partial_last_page_is_kept(spark, workdir, chain):
    pages, _ = combine_files(chain.where("chain_pos = 0"), workdir, size=SIZE)
    last = pages.where("path = 'a/1' AND block_no = 9").first()
    assert last["data"] == b"end" and pages.count() == 11


def test_no_page_moves(spark, workdir, chain):
    pages, _ = combine_files(chain, workdir, size=SIZE)
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and plan.index("MapInArrow") < plan.index("Exchange")
    # Nothing above the reading of pages, and no exchange below it, carries them.
    assert "data#" not in plan[plan.index("Exchange") :]
    assert not re.search(r"Exchange [^\n]*data", plan)


def test_pages_that_lose_are_never_read(spark, workdir, chain):
    with open(f"{workdir}/1/a/INCREMENTAL.1", "wb") as f:
        f.write(gzip.compress(increment([(8, page(18)), (2, page(12)), (4, page(14))], 20)))
    # Of the plain newest increment the second page may be lost if nobody wants it.
    only = chain.where("location = '2/a/INCREMENTAL.1'")
    os.truncate(f"{workdir}/2/a/INCREMENTAL.1", 12 + 8 + SIZE)
    index = scan_page_index(only, workdir, SIZE).where("kind = 'page'")
    assert fetch_pages(index.where("block_no = 2"), workdir).first()["data"] == page(22)
    with pytest.raises(Exception, match="of 16 bytes"):
        fetch_pages(index.where("block_no = 30"), workdir).collect()


def test_stretches_of_one_file_are_read_by_several_tasks(spark, workdir):
    with open(f"{workdir}/big", "wb") as f:
        f.write(b"".join(page(i % 251) for i in range(3000)))
    rows = spark.range(3000).select(F.lit("big").alias("location"), F.lit("none").alias("codec"), (F.col("id") * SIZE).alias("offset"), F.lit(SIZE).alias("length"))
    got = fetch_pages(rows.orderBy(F.rand(3)), workdir, stretch=4096)
    spread = got.select("offset", "data", F.spark_partition_id().alias("task")).collect()
    assert all(r["data"] == page(r["offset"] // SIZE % 251) for r in spread) and len(spread) == 3000
    assert fetch_pages(rows.limit(0), workdir).count() == 0


def test_row_merge_keeps_its_rules(spark):
    rows = spark.createDataFrame([("f", 0, 1, "x"), ("f", 1, 1, "y")], "path STRING, chain_pos INT, block_no BIGINT, location STRING")
    none = spark.createDataFrame([], "path STRING, chain_pos INT, truncation_block_length BIGINT")
    assert combine_chain(rows, none).first()["location"] == "y"


def test_pages_of_whole_files_are_numbered_by_several_tasks(spark, workdir):
    """Sizes say all about whole files: none is opened, and a large one is not the work of one task."""
    sizes = {"big": 200_000 * SIZE + 3, "even": 2 * SIZE, "short": 1, "empty": 0, "unknown": None}
    files = spark.createDataFrame([(name, 0, f"absent/{name}", "none", n) for name, n in sizes.items()], "path STRING, chain_pos INT, location STRING, codec STRING, size BIGINT")
    index = scan_page_index(files, workdir, SIZE)
    pages = index.groupBy("path", "kind").agg(F.count_distinct("block_no"), F.max("offset"), F.sum(F.col("length").cast("bigint")), F.count(F.lit(1))).collect()
    assert sorted(map(tuple, pages)) == [
        ("big", "page", 200_001, 200_000 * SIZE, sizes["big"], 200_001), ("even", "page", 2, SIZE, 2 * SIZE, 2), ("short", "page", 1, 0, 1, 1)
    ]
    assert index.where("path = 'big'").select(F.spark_partition_id()).distinct().count() > 1
