"""Full snapshots that pick up where a dead run stopped."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.replicate import run_totals
from ..operators.resume import pending_files, reusable_objects
from ..session import materialize
from ..sources.store import STEP, SnapshotInfo, write_manifest
from .snapshots import check_identity

_PROGRESS = "path STRING, size BIGINT, sha256 STRING, settings STRING, _step INT"


def _flat(df: DataFrame, name: str) -> Column:
    """The column; nested values as JSON that shows their NULLs."""
    nested = isinstance(df.schema[name].dataType, (T.ArrayType, T.MapType, T.StructType))
    return F.to_json(F.struct(name), {"ignoreNullFields": "false"}) if nested else F.col(name)


def part_prints(df: DataFrame, part: str) -> DataFrame:
    """``(path, size, sha256)`` per part: row count and an order-free print of its rows.

    Count, sum and exclusive-or of row hashes are partial aggregates, so a part
    that owns most rows is fingerprinted by all tasks.
    """
    # xxhash64 skips a NULL, so each value is hashed with a flag that tells where one stands.
    row = F.xxhash64(*[x for c in sorted(df.columns) for x in (F.col(c).isNull(), _flat(df, c))])
    found = df.groupBy(F.col(part).cast("string").alias("path")).agg(
        F.count(F.lit(1)).alias("size"), F.bit_xor(row).alias("_xor"), F.sum(row.cast("decimal(38,0)")).alias("_sum")
    )
    return found.select("path", "size", F.sha2(F.concat_ws(":", "size", "_xor", "_sum"), 256).alias("sha256"))


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def resume_state(df: DataFrame, root: str, info: SnapshotInfo, part: str, settings: str) -> tuple[DataFrame, DataFrame]:
    """``(source, status)``: prints of the new input, and what is left of a dead run.

    Stored rows are read again and compared with what was recorded for them, and
    the recorded print with the new input; only parts that pass both can stay.
    """
    spark, target = df.sparkSession, f"{root.rstrip('/')}/{info.backup_id}"
    source = materialize(part_prints(df, part))
    progress = _read(spark, f"{target}/progress")
    stored = _read(spark, f"{target}/data") if progress is not None else None
    if stored is None:
        progress = spark.createDataFrame([], _PROGRESS)
        stored_prints = source.where(F.lit(False))
    else:
        # Other settings would write other rows for the same input.
        progress = progress.where(F.col("settings") == settings)
        stored_prints = materialize(part_prints(stored.drop(STEP), part))
    recorded = progress.select(
        F.lit(info.backup_id).alias("backup_id"), "path", "size", "sha256",
        F.col("size").alias("repo_size"), F.col("sha256").alias("repo_sha256"),
    )
    stored_prints = stored_prints.withColumn("backup_id", F.lit(info.backup_id))
    digests = stored_prints.select("backup_id", "path", F.col("sha256").alias("stored_sha256"))
    return source, materialize(reusable_objects(recorded, stored_prints, digests, source))


def backup_resumable(
    df: DataFrame, root: str, info: SnapshotInfo, part: str, steps: int = 16, settings: str = ""
) -> DataFrame:
    """Full snapshot in steps; a rerun after a crash writes only the steps it must.

    ``part`` should be a partition column of the input, so that a step reads only
    its own directories. Every part belongs to one step; a step is kept if all
    its parts can be reused, otherwise its directory is written anew. The
    manifest comes last. Returns the totals: files, bytes and so on count parts
    and rows.
    """
    spark, target = df.sparkSession, f"{root.rstrip('/')}/{info.backup_id}"
    if _read(spark, f"{target}/manifest") is not None:
        raise FileExistsError(f"snapshot {info.backup_id} is already published")
    check_identity(spark, root, info)
    source, status = resume_state(df, root, info, part, settings)
    to_copy, _ = pending_files(source, status)
    stale = status.where(F.col("status") != "reusable").select("path")

    def step_of(name):
        return F.pmod(F.xxhash64(F.col(name).cast("string")), F.lit(steps)).cast("int")

    dirty = to_copy.select("path").unionByName(stale).select(step_of("path").alias("k")).distinct()
    # At most ``steps`` numbers.
    for k in sorted(r["k"] for r in dirty.collect()):
        df.where(step_of(part) == k).write.mode("overwrite").parquet(f"{target}/data/{STEP}={k}")
        done = source.where(step_of("path") == k).withColumn("settings", F.lit(settings))
        done.write.mode("overwrite").parquet(f"{target}/progress/{STEP}={k}")
    write_manifest(spark, root, info)
    return run_totals(source, source.where(F.lit(False)))
