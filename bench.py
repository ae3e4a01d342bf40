"""Headline queries at one scale factor; prints one JSON line.

Each query runs once to warm up and then three times; the median counts. The
result is consumed in full without leaving the executors. Beside the queries,
in the total: verifying a repository of 1 GB, and snapshots of 10 million rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans import backup_full, backup_incremental, restore_table, verify  # noqa: E402
from tidemark.session import build_session  # noqa: E402
from tidemark.sources.store import SnapshotInfo  # noqa: E402
from workload import QUERIES  # noqa: E402

HEADLINE = [
    "chain_roots",
    "retention_all_rules",
    "prune_objects",
    "build_catalog",
    "verify_files",
    "body_digests",
    "page_fingerprints",
    "missing_segments",
    "segment_gaps",
    "classify_push",
    "changed_in_window",
    "changed_in_windows",
    "combine_chain",
    "summary_gaps",
    "incremental_snapshot",
    "restore_chain",
    "replay_time",
    "replay_over_base",
    "reusable_objects",
]


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def write_repository(root: str, files: int = 128, size: int = 8 << 20) -> int:
    """One plain backup of ``files`` files; returns its bytes."""
    backup, block, entries = f"{root}/20260101T000000F", os.urandom(size - 8), []
    os.makedirs(f"{backup}/base")
    for n in range(files):
        body = n.to_bytes(8, "little") + block
        with open(f"{backup}/base/{n}", "wb") as out:
            out.write(body)
        entries.append(f'{{ "Path": "base/{n}", "Size": {size}, "Last-Modified": "2026-01-01 00:00:00 GMT", "Checksum-Algorithm": "SHA256", "Checksum": "{hashlib.sha256(body).hexdigest()}" }}')
    head = '{ "PostgreSQL-Backup-Manifest-Version": 2,\n"System-Identifier": 5,\n"Files": [\n' + ",\n".join(entries)
    head += '\n],\n"WAL-Ranges": [\n{ "Timeline": 1, "Start-LSN": "0/3000028", "End-LSN": "0/3100028" }\n],\n'
    with open(f"{backup}/backup_manifest", "w") as out:
        out.write(head + f'"Manifest-Checksum": "{hashlib.sha256(head.encode()).hexdigest()}"}}\n')
    sidecar = {"version": 3, "server": "s", "encryption_recipients": None, "compression": "none", "storage_layout_version": 1, "wal_segments": None, "system_identifier": 5, "directories": [], "type": "full"}
    with open(f"{backup}/Storage-Metadata.json", "w") as out:
        json.dump(sidecar, out)
    return files * size


def volumes(spark, rows: int = 10_000_000) -> dict[str, float]:
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    out, started = {}, 0.0

    def lap(name):
        nonlocal started
        out[name], started = round(time.perf_counter() - started, 2), time.perf_counter()

    size = write_repository(f"{root}/repository")
    started = time.perf_counter()
    summary, _ = verify(spark, f"{root}/repository")
    status = [r["status"] for r in summary.collect()]
    lap("verify_1gb_seconds")
    if status != ["OK"]:
        raise RuntimeError(f"verification ended {status}")
    out["verify_mb_per_second"] = round(size / 1e6 / out["verify_1gb_seconds"], 1)
    spark.range(rows).selectExpr("id", "concat(sha2(cast(id AS string), 256), '0123456789abcdef') AS body").write.parquet(f"{root}/table")
    table, full = spark.read.parquet(f"{root}/table"), "20260101T000000F"
    started = time.perf_counter()
    backup_full(table, f"{root}/plain", SnapshotInfo(full))
    lap("snapshot_10m_rows_seconds")
    backup_full(table, f"{root}/snapshots", SnapshotInfo(full), ["id"])
    lap("snapshot_10m_rows_with_prints_seconds")
    changed = table.selectExpr("id", "CASE WHEN id % 1000 < 11 AND id < 1000000 THEN 'new' ELSE body END AS body")
    backup_incremental(changed, f"{root}/snapshots", SnapshotInfo(f"{full}_20260102T000000I", "incremental", full), ["id"])
    lap("increment_by_prints_seconds")
    backup_incremental(changed, f"{root}/plain", SnapshotInfo(f"{full}_20260102T000000I", "incremental", full), ["id"])
    lap("increment_by_rows_seconds")
    consume(restore_table(spark, f"{root}/snapshots", f"{full}_20260102T000000I", ["id"]))
    lap("restore_10m_rows_seconds")
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = sys.argv[1:] or HEADLINE
    conf = {"spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8", "spark.driver.memory": "12g"}
    conf |= {"spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR"}
    conf["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")  # one machine only
    spark = build_session("bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        consume(QUERIES[name](spark, sf_dir))
        runs = []
        for _ in range(repeats):
            started = time.perf_counter()
            consume(QUERIES[name](spark, sf_dir))
            runs.append(time.perf_counter() - started)
        times[name] = round(statistics.median(runs), 3)
    whole = volumes(spark) if not sys.argv[1:] else {}
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "volumes": whole}))


if __name__ == "__main__":
    main()
