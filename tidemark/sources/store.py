"""Writing: snapshots with the manifest last, and fan-out; ``archive.py`` has the log archive.

Layout of a snapshot directory: ``<dir>/<id>/data`` (parquet) and, written only
after the data is complete, ``<dir>/<id>/manifest`` (parquet).
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prints import FOLDERS, bits_for, bucket_prints, row_prints
from ..schemas import REPLICAS
from .archive import archive_ingest, read_archive, vacuum_archive  # noqa: F401

# Directory level of snapshots that were written step by step.
STEP = "_step"


@dataclass(frozen=True)
class SnapshotInfo:
    backup_id: str
    type: str = "full"
    parent_backup_id: str | None = None
    server: str | None = None
    system_identifier: int | None = None
    annotation: str | None = None


def part_digests(spark: SparkSession, data_dir: str) -> DataFrame:
    """``(part, size, sha256)`` of the data files Spark wrote below a directory.

    Such files are never empty or hidden and of moderate size, so the binary-file
    source reads them on every file system Spark can write to, and the JVM hashes.
    A file the store lists but cannot deliver intact has a NULL hash.
    """
    # Listed paths are qualified (file:/x, s3a://b/x); cut after the directory's own text.
    anchor = re.sub("^file:/+", "/", data_dir.rstrip("/")) + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(data_dir)
    part = F.substring_index("path", anchor, -1).alias("part")
    read = files.select(part, F.sha2("content", 256).alias("sha256"))
    return files.select(part, F.col("length").alias("size")).join(read, "part", "left")


def publish_snapshot(df: DataFrame, root: str, info: SnapshotInfo, partition_by: list[str] | None = None, key: list[str] | None = None) -> None:
    """Write data, then the part digests as the manifest. Never overwrites.

    A reader that lists manifests cannot see a snapshot before it is complete.
    With ``key`` the prints of the rows are stored beside the data, from which the
    next increment is told without reading the data again.
    """
    spark, target = df.sparkSession, f"{root.rstrip('/')}/{info.backup_id}"
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{target}/data")
    if key:
        stored = spark.read.parquet(f"{target}/data")
        bits = bits_for(stored.count())
        prints = write_prints(row_prints(stored, key, bits), target)
        write_buckets(bucket_prints(prints, key).withColumns({"holder": F.lit(info.backup_id), "bits": F.lit(bits)}), target)
    write_manifest(spark, root, info)


def write_prints(prints: DataFrame, target: str) -> DataFrame:
    """Row prints ``(bucket, <key>, print)`` in folders by bucket; returned as stored."""
    folder = F.pmod(F.col("bucket"), F.lit(FOLDERS)).alias("folder")
    prints.select("*", folder).write.mode("overwrite").partitionBy("folder").parquet(f"{target}/prints")
    return prints.sparkSession.read.schema(prints.schema).parquet(f"{target}/prints").select(*prints.columns)


def write_buckets(buckets: DataFrame, target: str) -> None:
    """Bucket prints with the snapshot that holds the row prints of each; 65,536 rows at most."""
    buckets.select("bucket", "rows", "xor", "sum", "holder", "bits").coalesce(1).write.mode("overwrite").parquet(f"{target}/buckets")


def read_buckets(spark: SparkSession, root: str, backup_id: str) -> DataFrame | None:
    """Bucket prints of a published snapshot; None if it was stored without them."""
    try:
        return spark.read.parquet(f"{root.rstrip('/')}/{backup_id}/buckets")
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_prints(spark: SparkSession, root: str, buckets: DataFrame, schema) -> DataFrame:
    """Row prints of ``(bucket, holder)``: only the folders of these buckets, of the snapshots that hold them."""
    held = buckets.select("bucket", "holder", F.pmod(F.col("bucket"), F.lit(FOLDERS)).alias("folder"))
    # At most FOLDERS numbers for each snapshot of a chain.
    wanted = held.groupBy("holder").agg(F.collect_set("folder").alias("folders")).collect()
    found = spark.createDataFrame([], schema)
    for r in wanted:
        base = f"{root.rstrip('/')}/{r['holder']}/prints"
        part = spark.read.schema(schema).parquet(*[f"{base}/folder={k}" for k in sorted(r["folders"])])
        mine = held.where(F.col("holder") == r["holder"]).select("bucket")
        found = found.unionByName(part.select(*schema.names).join(F.broadcast(mine), "bucket", "left_semi"))
    return found


def write_manifest(spark: SparkSession, root: str, info: SnapshotInfo) -> None:
    """Digest the data files as stored and publish the snapshot."""
    target = f"{root.rstrip('/')}/{info.backup_id}"
    meta = {
        "type": F.lit(info.type),
        "parent_backup_id": F.lit(info.parent_backup_id).cast("string"),
        "server": F.lit(info.server).cast("string"),
        "system_identifier": F.lit(None if info.system_identifier is None else str(info.system_identifier)).cast("decimal(20,0)"),
        "annotation": F.lit(info.annotation).cast("string"),
        "published_at": F.current_timestamp(),
    }
    unread = F.raise_error(F.concat(F.lit("cannot read back "), F.col("part"))).cast("string")
    parts = part_digests(spark, f"{target}/data").withColumns({"sha256": F.coalesce("sha256", unread), **meta})
    parts.write.mode("error").parquet(f"{target}/manifest")


def snapshot_manifests(spark: SparkSession, root: str) -> DataFrame | None:
    """Part rows of every published snapshot below ``root``; None if there is none."""
    root = root.rstrip("/")
    try:
        rows = spark.read.option("basePath", root).parquet(f"{root}/*/manifest")
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return rows.withColumn("backup_id", F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/manifest/[^/]*$", 1))


def snapshot_catalog(spark: SparkSession, root: str) -> DataFrame:
    """One row per published snapshot, in the columns of the backup catalog that apply."""
    rows = snapshot_manifests(spark, root)
    if rows is None:
        return spark.createDataFrame(
            [],
            "backup_id STRING, type STRING, parent_backup_id STRING, server STRING, system_identifier DECIMAL(20,0),"
            " annotation STRING, stop_time TIMESTAMP, files BIGINT, bytes BIGINT",
        )
    keys = ["backup_id", "type", "parent_backup_id", "server", "system_identifier", "annotation"]
    return rows.groupBy(*keys).agg(
        F.max("published_at").alias("stop_time"), F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")
    )


def read_snapshot(spark: SparkSession, root: str, backup_id: str) -> DataFrame:
    root = root.rstrip("/")
    try:
        spark.read.parquet(f"{root}/{backup_id}/manifest")
    except AnalysisException as exc:
        raise LookupError(f"snapshot {backup_id} is not published") from exc
    return spark.read.parquet(f"{root}/{backup_id}/data").drop(STEP)


def write_fan_out(df: DataFrame, targets: dict[str, str], backup_id: str, data_object: str = "data") -> DataFrame:
    """Write the same rows to every target; a failing one is dropped, others go on.

    The rows are computed once, for the first target that commits. The others
    read that copy, side by side, so all copies agree even if executors are lost
    in between. Raises only if no target committed.
    """
    spark = df.sparkSession

    def write(name, rows):
        path = f"{targets[name].rstrip('/')}/{backup_id}/{data_object}"
        try:
            rows.write.mode("error").parquet(path)
            return path, (name, backup_id, data_object, "committed", None)
        except Exception as exc:  # whatever a store raises, the other targets go on
            return None, (name, backup_id, data_object, "failed", str(exc).splitlines()[0][:500])

    results, waiting, copy = [], list(targets), None
    while waiting and copy is None:
        copy, row = write(waiting.pop(0), df)
        results.append(row)
    if copy is None:
        raise RuntimeError("no target committed: " + "; ".join(f"{r[0]}: {r[4]}" for r in results))
    if waiting:
        with ThreadPoolExecutor(max_workers=len(waiting)) as pool:
            results += [row for _, row in pool.map(lambda name: write(name, spark.read.parquet(copy)), waiting)]
    return spark.createDataFrame(results, REPLICAS)
