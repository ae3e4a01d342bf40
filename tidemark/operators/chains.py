"""Backup chains: the root full backup of every backup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..joins import bounded_broadcast
from ..session import materialize

RESTORE_MAX_DEPTH = 64


def orphans(backups: DataFrame) -> DataFrame:
    """Incrementals without a recorded parent, or whose parent does not exist."""
    incrementals = backups.where(F.col("type") == "incremental").select("backup_id", "parent_backup_id")
    no_parent = incrementals.where(F.col("parent_backup_id").isNull()).select(
        "backup_id", "parent_backup_id", F.lit("no_parent").alias("reason")
    )
    present = backups.select(F.col("backup_id").alias("parent_backup_id"))
    missing = (
        incrementals.where(F.col("parent_backup_id").isNotNull())
        .join(present, "parent_backup_id", "left_anti")
        .select("backup_id", "parent_backup_id", F.lit("missing_parent").alias("reason"))
    )
    return no_parent.unionByName(missing)


def resolve_chains(backups: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(backup_id, chain_id, depth, status)`` for every backup.

    Each round doubles the distance a pointer spans, so a chain of depth d takes
    about log2(d) joins. Settled backups leave the probing side and are written
    once. Each round is checkpointed, because the next one reads it twice.

    Many backups may point at one parent. The parent side has one row per id, so
    the probing side is the only one that can be skewed, and it is the side a
    left join lets AQE split. Ids are unique, as the directories of a repository
    are; of a repeated id each row would count as a parent.

    ``status`` is ok, missing_parent, no_parent, cycle or too_deep; ``chain_id``
    is NULL unless a root was found. With ``max_depth`` a chain of more backups
    than that is too_deep, and cycles (which never end) are reported likewise.
    """
    full = F.col("type") == "full"
    no_parent = ~full & F.col("parent_backup_id").isNull()
    state = materialize(
        backups.select(
            F.col("backup_id").alias("id"),
            F.when(~full, F.col("parent_backup_id")).alias("ptr"),
            F.when(full | no_parent, 0).otherwise(1).cast("bigint").alias("depth"),
            F.when(full, F.col("backup_id")).alias("root"),
            F.when(full, "ok").when(no_parent, "no_parent").alias("status"),
        )
    )
    open_rows = F.col("status").isNull()
    total, left = state.agg(F.count(F.lit(1)), F.count_if(open_rows)).first()
    settled, active = [state.where(~open_rows)], state.where(open_rows)
    span = 1
    limit = min(total, max_depth) if max_depth else total
    while left and span <= limit:
        target = reduce(DataFrame.unionByName, settled, active).select(
            F.col("id").alias("ptr"),
            F.lit(True).alias("_found"),
            F.col("ptr").alias("_ptr"),
            F.col("depth").alias("_depth"),
            F.col("root").alias("_root"),
            F.col("status").alias("_status"),
        )
        if left * 8 < total:
            # Few pointers are left: find their targets by a scan instead of a full shuffle.
            target = target.join(bounded_broadcast(active.select("ptr").distinct()), "ptr", "left_semi")
        stepped = materialize(
            active.join(target, "ptr", "left").select(
                "id",
                F.col("_ptr").alias("ptr"),
                (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
                F.col("_root").alias("root"),
                F.when(F.col("_found").isNull(), "missing_parent").otherwise(F.col("_status")).alias("status"),
            )
        )
        settled.append(stepped.where(~open_rows))
        active = stepped.where(open_rows)
        left = active.count()
        span *= 2
    state = reduce(DataFrame.unionByName, settled, active)
    status = F.when(open_rows, "too_deep" if max_depth else "cycle").otherwise(F.col("status"))
    if max_depth:
        status = F.when((status == "ok") & (F.col("depth") >= max_depth), "too_deep").otherwise(status)
    return state.withColumn("status", status).select(
        F.col("id").alias("backup_id"),
        F.when(F.col("status") == "ok", F.col("root")).alias("chain_id"),
        F.when(F.col("status") == "ok", F.col("depth")).alias("depth"),
        "status",
    )
