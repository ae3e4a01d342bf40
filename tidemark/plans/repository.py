"""Jobs over a repository directory: load, verify, prune, plan a restore."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import naming
from ..functions.lsn import SEGMENT_BYTES
from ..joins import bounded_broadcast
from ..operators import catalog as cat
from ..operators.chains import RESTORE_MAX_DEPTH, resolve_chains
from ..operators.prune import prune_objects, prune_segments, prune_summary
from ..operators.retention import Policy, kept_fulls, low_water, retention_plan
from ..operators.verify import mismatches, verify_files, verify_summary
from ..operators.wal import required_segments
from ..session import materialize
from ..sources.metadata import decode_sidecars, manifest_files, manifest_headers, manifest_warnings, scan_manifests
from ..sources.objects import scan_contents, scan_objects, scan_segments, split_backup_path, stored_digests


@dataclass(frozen=True)
class Repository:
    """Lazy tables of one repository directory."""

    spark: SparkSession
    root: str
    objects: DataFrame
    segments: DataFrame
    manifests: DataFrame
    sidecars: DataFrame
    backups: DataFrame
    warnings: DataFrame


def open_repository(
    spark: SparkSession,
    root: str,
    temp_marker: str | None = None,
    seg_bytes: int = SEGMENT_BYTES,
    inventory: DataFrame | None = None,
    with_segments: bool = True,
) -> Repository:
    """List and decode a repository; ``with_segments=False`` leaves the log archive unlisted."""
    # One listing serves everything that follows.
    objects = materialize(scan_objects(spark, root, temp_marker=temp_marker, inventory=inventory))
    archived = scan_objects(spark, root, prefix=naming.WAL_DIR, temp_marker=temp_marker, inventory=inventory)
    segments = scan_segments(materialize(archived) if with_segments else archived.limit(0), seg_bytes)
    # Manifests can be large and are read again where they are needed; sidecars are small.
    manifests = scan_manifests(scan_contents(spark, root, names=[naming.MANIFEST_NAME], objects=objects))
    documents = materialize(decode_sidecars(scan_contents(spark, root, names=[naming.SIDECAR_NAME], objects=objects)))
    backups, warnings = cat.build_catalog(objects, documents, manifest_headers(manifests))
    warnings = warnings.unionByName(manifest_warnings(manifests).select(*warnings.columns))
    sidecars = documents.where(F.col("error").isNull()).drop("error")
    return Repository(spark, root, objects, segments, manifests, sidecars, backups, warnings)


def verify(
    spark: SparkSession, root: str, backup_id: str | None = None, full: bool = False, temp_marker: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(summary, mismatches)``: every recorded file is read and hashed again."""
    repo = open_repository(spark, root, temp_marker, with_segments=False)
    manifests, ids = repo.manifests, cat.distinct_backup_ids(repo.objects)
    if backup_id is not None:
        manifests, ids = manifests.where(F.col("backup_id") == backup_id), ids.where(F.col("backup_id") == backup_id)
    codecs = repo.sidecars.select(
        "backup_id", "codec", (F.size(F.coalesce("recipients", F.array().cast("array<string>"))) > 0).alias("encrypted")
    )
    stored = split_backup_path(repo.objects.withColumn("location", F.col("path"))).where(
        ~F.col("path").isin(naming.MANIFEST_NAME, naming.SIDECAR_NAME, naming.CHECKPOINT_NAME)
    )
    # The codec joins the listing, not the bodies; encrypted bodies are not decoded.
    readable = codecs.select("backup_id", F.when(F.col("encrypted"), "none").otherwise(F.col("codec")).alias("codec"))
    listed = stored.join(bounded_broadcast(readable), "backup_id")
    files = manifest_files(manifests).join(bounded_broadcast(codecs.select("backup_id")), "backup_id", "left_semi")
    files = materialize(files.select("backup_id", "path", "size", "sha256"))
    if not full:
        wanted = files.where(F.col("sha256").isNotNull()).select("backup_id", "path")
        listed = listed.join(wanted, ["backup_id", "path"], "left_semi")
    digests = stored_digests(listed.select("backup_id", "path", "location", "size", "codec"), root)
    checked = materialize(verify_files(files, digests, codecs, full))
    flags = (
        ids.join(manifests.select("backup_id", "readable", "checksum_ok"), "backup_id", "left")
        .join(codecs.select("backup_id", F.lit(True).alias("sidecar_ok")), "backup_id", "left")
        .na.fill(False, ["readable", "checksum_ok", "sidecar_ok"])
    )
    return verify_summary(checked, flags), mismatches(checked)


@dataclass(frozen=True)
class PrunePlan:
    plan: DataFrame
    objects: DataFrame
    segments: DataFrame
    low_water_lsn: int | None
    summary: DataFrame


def plan_prune(
    backups: DataFrame,
    objects: DataFrame,
    segments: DataFrame,
    policy: Policy,
    seg_bytes: int = SEGMENT_BYTES,
    per_timeline: bool = False,
) -> PrunePlan:
    """Retention plan, and what it allows to delete. Reads only."""
    backups = materialize(backups)
    kept = materialize(kept_fulls(backups, policy))
    plan = materialize(retention_plan(backups, policy, kept=kept))
    water = low_water(backups, kept).first()[0]
    cutoff: DataFrame | object = F.lit(water).cast("bigint")
    if per_timeline:
        starts = backups.join(kept.select(F.col("chain_id").alias("backup_id")), "backup_id", "left_semi")
        cutoff = starts.groupBy(F.col("timeline").alias("tli")).agg(
            F.when(F.count_if(F.col("start_lsn").isNull()) == 0, F.min("start_lsn")).alias("low_water_lsn")
        )
    doomed = prune_objects(plan, objects)
    old = prune_segments(segments, cutoff, per_timeline, seg_bytes)
    return PrunePlan(plan, doomed, old, water, prune_summary(plan, doomed, old))


def prune(
    spark: SparkSession, root: str, policy: Policy, dry_run: bool = True, temp_marker: str | None = None, **options
) -> PrunePlan:
    """Plan, and with ``dry_run=False`` delete: manifests first, then bodies and segments."""
    repo = open_repository(spark, root, temp_marker)
    result = plan_prune(repo.backups, repo.objects, repo.segments, policy, **options)
    if not dry_run:
        # Fix the lists before the listing they come from starts to change.
        objects, segments = materialize(result.objects), materialize(result.segments)
        result = PrunePlan(
            result.plan, objects, segments, result.low_water_lsn, prune_summary(result.plan, objects, segments)
        )
        delete_paths(objects.where(F.col("delete_order") == 0).select("path"), root)
        delete_paths(objects.where(F.col("delete_order") == 1).select("path"), root)
        delete_paths(segments.select("path"), root)
    return result


def delete_paths(paths: DataFrame, root: str) -> None:
    """Delete files below a mounted ``root`` from the executors; absent files are fine.

    Stores that are not mounted as a file system take the planned table instead.
    """
    if "://" in root and not root.startswith("file:"):
        raise ValueError("only mounted roots can be deleted from; use the planned paths with the store's own tool")
    base = root.split("file:", 1)[-1] if root.startswith("file:") else root

    def remove(rows):
        import os

        for row in rows:
            try:
                os.remove(os.path.join(base, row["path"]))
            except FileNotFoundError:
                pass

    paths.foreachPartition(remove)


def restore_plan(
    backups: DataFrame,
    objects: DataFrame,
    segments: DataFrame,
    backup_id: str | None = None,
    wal: str = "all",
    seg_bytes: int = SEGMENT_BYTES,
) -> DataFrame:
    """``(seq, kind, backup_id, path, size)``: what a restore copies, in chain order.

    Without ``backup_id`` the latest committed backup is taken. ``wal`` is
    ``all`` archived segments or only those ``needed`` from the chain on.
    """
    if wal not in ("all", "needed"):
        raise ValueError("wal must be all or needed")
    backups = materialize(backups)
    if backup_id is None:
        newest = backups.where(F.col("stop_time").isNotNull()).agg(F.max_by("backup_id", F.struct("stop_time", "backup_id")))
        backup_id = newest.first()[0]
        if backup_id is None:
            raise LookupError("no committed backup")
    chain = chain_members(backups, backup_id)
    files = objects.withColumn("backup_id", naming.first_part("path")).join(F.broadcast(chain), "backup_id").select(
        "seq", F.lit("file").alias("kind"), "backup_id", "path", "size"
    )
    logs = segments
    if wal == "needed":
        need = backups.where(F.col("backup_id") == backup_id).select("timeline", "start_lsn").first()
        first = need["start_lsn"] // seg_bytes if need["start_lsn"] is not None else 0
        logs = logs.where(
            (F.col("kind") != "segment") | ((F.col("seg_no") >= first) & (F.col("tli") >= (need["timeline"] or 0)))
        )
    last = F.lit(None).cast("string")
    return files.unionByName(
        logs.select(F.lit(1 << 20).alias("seq"), F.lit("wal").alias("kind"), last.alias("backup_id"), "path", "size")
    )


def chain_members(backups: DataFrame, backup_id: str) -> DataFrame:
    """``(backup_id, seq)`` from the root full to ``backup_id``: at most 64 rows.

    An id names its ancestors (``<full>_<increment>_…``), so one job fetches the
    whole chain, of any length. The parent pointers decide all the same: a parent
    that the id does not name is looked up by itself.
    """
    known: dict = {}

    def fetch(ids: list) -> None:
        rows = backups.where(F.col("backup_id").isin(ids)).select("backup_id", "type", "parent_backup_id")
        known.update((r["backup_id"], r) for r in rows.collect())

    parts = backup_id.split("_") if isinstance(backup_id, str) else []
    fetch(["_".join(parts[: n + 1]) for n in range(len(parts))] or [backup_id])
    chain, current, seen = [], backup_id, set()
    while True:
        if current not in known:
            fetch([current])
        row = known.get(current)
        if row is None:
            raise LookupError(f"backup {current} not found")
        chain.append(current)
        if row["type"] == "full":
            break
        if row["parent_backup_id"] is None:
            raise LookupError(f"incremental backup {current} has no parent")
        if len(chain) >= RESTORE_MAX_DEPTH or current in seen:
            raise LookupError(f"backup chain of {backup_id} exceeds {RESTORE_MAX_DEPTH} (cycle?)")
        seen.add(current)
        current = row["parent_backup_id"]
    ordered = list(reversed(chain))
    return backups.sparkSession.createDataFrame(
        list(zip(ordered, range(len(ordered)))), T.StructType([backups.schema["backup_id"], T.StructField("seq", T.IntegerType())])
    )


__all__ = [
    "PrunePlan",
    "Repository",
    "chain_members",
    "delete_paths",
    "open_repository",
    "plan_prune",
    "prune",
    "required_segments",
    "resolve_chains",
    "restore_plan",
    "verify",
]
