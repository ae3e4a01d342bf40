"""Snapshot jobs on ordinary tables: full, incremental, rebuild, check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import identity_check
from ..operators.prints import bits_for, changes_by_prints, row_prints
from ..operators.snapshot import incremental_snapshot, restore_chain
from ..operators.verify import verify_files
from ..session import materialize
from ..sources.store import (
    SnapshotInfo,
    part_digests,
    publish_snapshot,
    read_buckets,
    read_prints,
    read_snapshot,
    snapshot_catalog,
    snapshot_manifests,
    write_buckets,
    write_manifest,
    write_prints,
)
from .repository import chain_members


class IdentityMismatch(RuntimeError):
    pass


def check_identity(spark: SparkSession, root: str, info: SnapshotInfo) -> None:
    if not info.system_identifier:
        return
    current = spark.createDataFrame(
        [(info.server, str(info.system_identifier))], "server STRING, current_id STRING"
    ).withColumn("current_id", F.col("current_id").cast("decimal(20,0)"))
    verdict = identity_check(snapshot_catalog(spark, root), current).where(F.col("server") == info.server).first()
    if verdict is not None and not verdict["ok"]:
        raise IdentityMismatch(
            f"server {info.server}: latest backup {verdict['latest_backup']} belongs to {verdict['recorded_id']}"
        )


def backup_full(df: DataFrame, root: str, info: SnapshotInfo, key: list[str] | None = None) -> None:
    """Identity check, then data, then the manifest; with ``key`` also the prints increments start from."""
    check_identity(df.sparkSession, root, info)
    publish_snapshot(df, root, info, key=key)


def backup_incremental(df: DataFrame, root: str, info: SnapshotInfo, key: list[str]) -> None:
    """Publish only what changed since the parent named in ``info``.

    If the parent was stored with prints, they are all that is read of it, and the
    increment stores those of the buckets it changes. Otherwise the parent is
    rebuilt and compared row by row.
    """
    if not info.parent_backup_id:
        raise ValueError("an incremental snapshot needs a parent")
    spark = df.sparkSession
    check_identity(spark, root, info)
    old = read_buckets(spark, root, info.parent_backup_id)
    if old is None:
        parent = restore_table(spark, root, info.parent_backup_id, key)
        publish_snapshot(incremental_snapshot(parent, df, key), root, info)
        return
    chain_members(materialize(snapshot_catalog(spark, root)), info.parent_backup_id)  # raises if a member is gone
    changed, buckets = increment_by_prints(df, root, info, key, old)
    changed.write.mode("error").parquet(f"{root.rstrip('/')}/{info.backup_id}/data")
    write_buckets(buckets, f"{root.rstrip('/')}/{info.backup_id}")
    write_manifest(spark, root, info)


def increment_by_prints(df: DataFrame, root: str, info: SnapshotInfo, key: list[str], old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(changed rows, buckets with their holders)``; writes the prints of the buckets that changed."""
    spark, target = df.sparkSession, f"{root.rstrip('/')}/{info.backup_id}"
    first = old.select("bits").first()
    # An empty parent has no bucket; any number of bits describes it.
    bits = first[0] if first else bits_for(df.count())
    schema = row_prints(df.limit(0), key, bits).schema

    def stored(differing: DataFrame) -> DataFrame:
        return read_prints(spark, root, old.join(F.broadcast(differing), "bucket", "left_semi"), schema)

    def keep(name: str, rows: DataFrame) -> DataFrame:
        return write_prints(rows, target) if name == "prints" else materialize(rows)

    changed, new, buckets = changes_by_prints(df, key, bits, old, stored, keep)
    touched = new.select("bucket").distinct().withColumn("_mine", F.lit(True))
    holders = old.select("bucket", "holder")
    owner = F.when(F.col("_mine"), F.lit(info.backup_id)).otherwise(F.col("holder"))
    buckets = buckets.join(touched, "bucket", "left").join(holders, "bucket", "left").withColumns({"holder": owner, "bits": F.lit(bits)})
    return changed, buckets


def restore_table(spark: SparkSession, root: str, backup_id: str, key: list[str]) -> DataFrame:
    """Rebuild the table a snapshot chain describes."""
    members = chain_members(materialize(snapshot_catalog(spark, root)), backup_id).orderBy("seq").collect()
    base, *increments = [read_snapshot(spark, root, r["backup_id"]) for r in members]
    return restore_chain(base, increments, key)


def verify_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """Stored part files of all published snapshots against their manifests."""
    rows = snapshot_manifests(spark, root)
    if rows is None:
        raise LookupError(f"no published snapshot below {root}")
    key = [F.col("backup_id"), F.col("part").alias("path")]
    expected = rows.select(*key, "size", "sha256")
    stored = part_digests(spark, root).where(F.col("part").rlike("^[^/]+/data/"))
    digests = stored.select(
        F.substring_index("part", "/", 1).alias("backup_id"),
        F.regexp_replace("part", "^[^/]+/data/", "").alias("path"),
        F.lit("none").alias("codec"),
        F.col("sha256").alias("stored_sha256"),
        F.col("size").alias("stored_size"),
        F.col("sha256").alias("plain_sha256"),
        F.col("size").alias("plain_size"),
        F.when(F.col("sha256").isNull(), "unreadable").alias("error"),
    )
    return verify_files(expected, digests)
