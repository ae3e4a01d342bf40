"""Interrupted runs: which one to resume and which of its objects can stay."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import naming


@dataclass(frozen=True)
class Gate:
    """What a checkpoint must agree on with the new run, recipients in order."""

    tool_version: str
    backup_type: str
    compression: str
    system_identifier: int
    parent_backup_id: str | None = None
    recipients: tuple[str, ...] = field(default_factory=tuple)

    def matches(self) -> Column:
        wanted_recipients = F.array(*[F.lit(r) for r in self.recipients]).cast("array<string>")
        return (
            F.col("tool_version").eqNullSafe(F.lit(self.tool_version))
            & F.col("backup_type").eqNullSafe(F.lit(self.backup_type))
            & F.col("parent_backup_id").eqNullSafe(F.lit(self.parent_backup_id).cast("string"))
            & F.col("compression").eqNullSafe(F.lit(self.compression))
            & F.col("system_identifier").eqNullSafe(F.lit(str(self.system_identifier)).cast("decimal(20,0)"))
            & F.col("recipients").eqNullSafe(wanted_recipients)
        )


def unfinished_backups(objects: DataFrame) -> DataFrame:
    """Ids that have a checkpoint and no manifest, from one pass over the listing."""
    part = naming.first_part("path")
    rest = F.expr("substring(path, length(_id) + 2)")
    named = objects.select("path", part.alias("_id")).where(naming.is_backup_id("_id"))
    seen = named.where(rest.isin(naming.MANIFEST_NAME, naming.CHECKPOINT_NAME)).groupBy("_id").agg(
        F.bool_or(rest == naming.MANIFEST_NAME).alias("_done"), F.bool_or(rest == naming.CHECKPOINT_NAME).alias("_cp")
    )
    return seen.where(F.col("_cp") & ~F.col("_done")).select(F.col("_id").alias("backup_id"))


def find_resumable(
    objects: DataFrame, checkpoints: DataFrame, gate: Gate, grace_seconds: int, now
) -> DataFrame:
    """``(backup_id, action, reason)`` per unfinished backup.

    reap: the checkpoint does not decode (always), or is older than the grace
    period (when there is one). leave: made under other settings, or superseded.
    resume: the newest id among the rest.
    """
    joined = unfinished_backups(objects).join(
        checkpoints.withColumn("_cp", F.lit(True)), "backup_id", "left"
    )
    now_col = F.lit(now).cast("timestamp")
    too_old = F.lit(False)
    if grace_seconds > 0:
        age_limit = F.make_dt_interval(secs=F.lit(grace_seconds))
        too_old = F.coalesce(now_col - F.col("checkpointed_at") > age_limit, F.lit(False))
    reason = (
        F.when(F.col("_cp").isNull(), "corrupt").when(too_old, "expired").when(~gate.matches(), "mismatch")
    )
    judged = joined.select("backup_id", reason.alias("reason"))
    newest = judged.where(F.col("reason").isNull()).agg(F.max("backup_id")).scalar()
    full_reason = F.coalesce("reason", F.when(F.col("backup_id") == newest, "newest").otherwise("superseded"))
    action = (
        F.when(full_reason.isin("corrupt", "expired"), "reap").when(full_reason == "newest", "resume").otherwise("leave")
    )
    return judged.select("backup_id", action.alias("action"), full_reason.alias("reason"))


def reusable_objects(
    checkpoint_files: DataFrame, objects: DataFrame, digests: DataFrame | None, source: DataFrame | None = None
) -> DataFrame:
    """``(backup_id, path, status)`` per file of a checkpoint.

    Sizes come from the listing and are tested first. ``digests`` is
    ``(backup_id, path, stored_sha256)``; build it only from
    :func:`size_survivors`, so bodies of other files are never read. ``source``
    is ``(path, sha256)`` of the new run's input; a different input overrides a
    good stored copy.
    """
    key = ["backup_id", "path"]
    listed = objects.select(*key, F.col("size").alias("_listed"))
    rows = checkpoint_files.join(listed, key, "left")
    if digests is not None:
        rows = rows.join(digests.select(*key, F.col("stored_sha256").alias("_stored")), key, "left")
    else:
        rows = rows.withColumn("_stored", F.lit(None).cast("string"))
    no_digest = F.col("repo_sha256").isNull() | F.coalesce(F.col("repo_size") == 0, F.lit(True))
    status = (
        F.when(naming.never_reuse("path"), "denied")
        .when(no_digest, "no_digest")
        .when(F.col("_listed").isNull(), "missing")
        .when(F.col("_listed") != F.col("repo_size"), "size_differs")
        .when(F.col("_stored").isNull() | (F.col("_stored") != F.col("repo_sha256")), "hash_differs")
    )
    if source is not None:
        # One source row per path, however many runs hold that path.
        rows = rows.join(source.select("path", F.col("sha256").alias("_source")), "path", "left")
        status = status.when(~F.col("_source").eqNullSafe(F.col("sha256")), "source_changed")
    return rows.select(*key, "size", "sha256", "repo_size", "repo_sha256", status.otherwise("reusable").alias("status"))


def size_survivors(checkpoint_files: DataFrame, objects: DataFrame) -> DataFrame:
    """``(backup_id, path)`` of files worth hashing: allowed, recorded, present, same size."""
    key = ["backup_id", "path"]
    recorded = checkpoint_files.where(
        ~naming.never_reuse("path") & F.col("repo_sha256").isNotNull() & (F.col("repo_size") > 0)
    )
    listed = objects.select(*key, F.col("size").alias("repo_size"))
    return recorded.join(listed, [*key, "repo_size"], "left_semi").select(*key)


def pending_files(source: DataFrame, reuse: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(to_copy, reused)``: what the new run still copies, and entries it keeps."""
    kept = reuse.where(F.col("status") == "reusable")
    to_copy = source.join(kept.select("path"), "path", "left_anti")
    reused = kept.join(source.select("path"), "path", "left_semi").drop("status")
    return to_copy, reused
