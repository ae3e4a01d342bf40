"""The backup catalog and questions answered from it alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import naming
from ..joins import bounded_broadcast, lookup


def distinct_backup_ids(objects: DataFrame, strict: bool = False) -> DataFrame:
    part = naming.first_part("path")
    shape = naming.is_backup_id if strict else naming.is_backup_dir
    return objects.select(part.alias("backup_id")).where(shape("backup_id")).distinct()


def manifest_header(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """Files, bytes, oldest and newest file time per backup, with its first log range.

    ``start_time`` and ``stop_time`` are the extremes of file modification times.
    """
    totals = files.groupBy("backup_id").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size").alias("bytes"),
        F.min("mod_time").alias("start_time"),
        F.max("mod_time").alias("stop_time"),
    )
    first = ranges.where(F.col("idx") == 0).select(
        "backup_id", "timeline", "start_lsn", F.col("end_lsn").alias("stop_lsn")
    )
    return totals.join(first, "backup_id", "full_outer").withColumn("files", F.coalesce("files", F.lit(0)))


def build_catalog(objects: DataFrame, sidecars: DataFrame, headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(backups, warnings)``. A backup without a readable sidecar becomes a warning.

    ``sidecars`` has one row per sidecar with an ``error`` column. What a sidecar
    says about type and parent wins over what the id suggests.
    """
    meta = sidecars.select(
        "backup_id",
        F.lit(True).alias("_has"),
        "error",
        F.col("type").alias("_type"),
        F.col("parent_backup_id").alias("_parent"),
        "server",
        "compression",
        "recipients",
        "annotation",
        "system_identifier",
    )
    head_columns = ["start_lsn", "stop_lsn", "timeline", "start_time", "stop_time", "files", "bytes"]
    found = distinct_backup_ids(objects).join(meta, "backup_id", "left")
    backups = (
        found.where(F.col("_has") & F.col("error").isNull())
        .join(headers.select("backup_id", *head_columns), "backup_id", "left")
        .select(
            "backup_id",
            F.coalesce("_type", naming.type_from_id("backup_id")).alias("type"),
            F.coalesce("_parent", naming.parent_from_id("backup_id")).alias("parent_backup_id"),
            "server",
            "compression",
            "recipients",
            "annotation",
            *head_columns,
            "system_identifier",
        )
    )
    warnings = found.where(F.col("_has").isNull() | F.col("error").isNotNull()).select(
        "backup_id", F.coalesce("error", F.lit("sidecar missing")).alias("error")
    )
    return backups, warnings


def filter_server(backups: DataFrame, server: str) -> DataFrame:
    return backups.where(F.col("server") == server)


def identity_check(backups: DataFrame, current_ids: DataFrame) -> DataFrame:
    """Per server: system id of its newest committed backup against the reported one.

    ``current_ids`` is ``(server, current_id)``. An id of 0 or NULL on either
    side means unknown and passes.
    """
    known = F.when(F.col("system_identifier") != 0, F.col("system_identifier"))
    stored = backups.where(F.col("stop_time").isNotNull()).groupBy("server").agg(
        F.max_by(F.struct("backup_id", known.alias("id")), F.struct("stop_time", "backup_id")).alias("_last"),
        F.min(known).alias("_lo"),
        F.max(known).alias("_hi"),
    )
    joined = stored.join(current_ids, "server", "left")
    recorded, current = F.col("_last.id"), F.when(F.col("current_id") != 0, F.col("current_id"))
    return joined.select(
        "server",
        F.col("_last.backup_id").alias("latest_backup"),
        recorded.alias("recorded_id"),
        current.alias("current_id"),
        F.coalesce(recorded == current, F.lit(True)).alias("ok"),
        F.coalesce(F.col("_lo") != F.col("_hi"), F.lit(False)).alias("several_ids"),
    )


def server_inventory(backups: DataFrame, roots: DataFrame) -> DataFrame:
    """Backups per server, with registered servers that have none."""
    counts = backups.groupBy("server").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(roots.select("server").distinct(), "server", "full_outer").select(
        "server", F.coalesce("n", F.lit(0)).alias("backups")
    )


def latest_backups(backups: DataFrame, mode: str = "time") -> DataFrame:
    """The latest backup per server, by stop time (committed only) or by id text."""
    if mode == "lexicographic":
        return backups.groupBy("server").agg(F.max("backup_id").alias("backup_id"))
    committed = backups.where(F.col("stop_time").isNotNull())
    return committed.groupBy("server").agg(
        F.max_by("backup_id", F.struct("stop_time", "backup_id")).alias("backup_id")
    )


def label_collisions(proposed: DataFrame, backups: DataFrame) -> DataFrame:
    """Proposed ``(server, backup_id)`` labels with a flag: not later than the server's latest label."""
    latest = backups.groupBy("server").agg(F.max("backup_id").alias("latest_id"))
    return lookup(proposed, latest, ["server"]).select(
        "server",
        "backup_id",
        "latest_id",
        F.coalesce(F.col("backup_id") <= F.col("latest_id"), F.lit(False)).alias("collides"),
    )


def update_annotation(catalog: DataFrame, notes: DataFrame) -> DataFrame:
    """Set (or with NULL or empty text clear) the annotation of the listed backups.

    ``notes`` is ``(backup_id, annotation)``; an id the catalog lacks is an error.
    """
    unknown = notes.join(catalog.select("backup_id"), "backup_id", "left_anti").take(5)
    if unknown:
        raise LookupError("unknown backup: " + ", ".join(str(r["backup_id"]) for r in unknown))
    edits = notes.select(
        "backup_id", F.lit(True).alias("_edit"), F.nullif(F.col("annotation"), F.lit("")).alias("_note")
    )
    edited = F.when(F.col("_edit"), F.col("_note")).otherwise(F.col("annotation"))
    return (
        catalog.join(bounded_broadcast(edits), "backup_id", "left")
        .withColumn("annotation", edited)
        .select(*catalog.columns)
    )
