"""Continuous ingest of log segments and progress of a running backup."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..schemas import REPLICAS
from ..session import materialize
from ..sources.store import archive_ingest

log = logging.getLogger(__name__)


def ingest_stream(
    incoming: DataFrame, archive: str, side_dir: str, low_water_seg: int | None = None, arrived: str | None = None
) -> DataStreamWriter:
    """Writer that adds arriving segments to the archive, each content once.

    The archive itself is the state: a micro-batch is compared with the archive
    as it stands and written under its own batch id, so a batch repeated after a
    failure changes nothing. The first content of a name is kept, by the column
    ``arrived`` and then by hash. Conflicts go to ``<side_dir>/conflicts`` and are
    logged; arrivals below the low-water segment go to ``<side_dir>/late``.
    ``incoming`` is a stream of ``(tli, name, sha256, size, seg_no)``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        fresh = batch
        if low_water_seg is not None:
            late = F.coalesce(F.col("seg_no") < low_water_seg, F.lit(False))
            batch.where(late).write.mode("overwrite").parquet(f"{side_dir}/late/batch={batch_id}")
            fresh = batch.where(~late)
        verdict = archive_ingest(fresh, archive, str(batch_id), arrived)
        target = f"{side_dir}/conflicts/batch={batch_id}"
        conflicts = verdict.where(F.col("status") == "conflict")
        conflicts.write.mode("overwrite").parquet(target)
        if not conflicts.isEmpty():
            log.error("batch %s: segments pushed again with other content, see %s", batch_id, target)

    return incoming.writeStream.foreachBatch(write)


def fan_out_stream(rows: DataFrame, targets: dict[str, str], status_dir: str) -> DataStreamWriter:
    """Write every micro-batch to all targets; a target that fails is dropped from then on.

    Each batch owns ``batch=<id>`` on every target, so a repeated batch replaces
    itself. The status of each write goes to ``<status_dir>``, which also tells a
    restarted stream what was dropped before, so that no target gets a hole.
    The stream fails when no target is left.
    """
    try:
        past = rows.sparkSession.read.schema(REPLICAS).parquet(status_dir).where("status = 'failed'")
        dropped = {r[0] for r in past.select(past.columns[0]).distinct().collect()}
    except AnalysisException:
        dropped = set()
    alive = {name: path for name, path in targets.items() if name not in dropped}

    def write(batch: DataFrame, batch_id: int) -> None:
        results = []
        for name, path in list(alive.items()):
            try:
                batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
                results.append((name, str(batch_id), "data", "committed", None))
            except Exception as exc:  # whatever a store raises, the other targets go on
                del alive[name]
                log.warning("target %s is dropped: %s", name, str(exc).splitlines()[0])
                results.append((name, str(batch_id), "data", "failed", str(exc).splitlines()[0][:500]))
        if not alive:
            raise RuntimeError("no target is left: " + "; ".join(f"{r[0]}: {r[4]}" for r in results))
        status = batch.sparkSession.createDataFrame(results, REPLICAS)
        status.coalesce(1).write.mode("overwrite").parquet(f"{status_dir}/batch={batch_id}")

    return rows.writeStream.foreachBatch(write)


def progress_stream(
    files: DataFrame, process: Callable[[DataFrame, int], None], progress_dir: str, every: int | None = None, order: list[str] | None = None
) -> DataStreamWriter:
    """Process arriving files and record which are done.

    Bound the files per step with the source option ``maxFilesPerTrigger``; each
    step adds its own part to the progress table, so recording costs the same at
    every step. With ``every``, files are recorded in groups of that many, counted
    across the steps in the order they arrived and, within a step, by ``order``
    (all columns by default): fewer than ``every`` processed files wait under
    ``<progress_dir>/waiting`` for the step that fills their group. A step that is
    repeated writes the same again. If recording fails, it is given up and the
    run goes on.
    """
    enabled = True

    def record(batch: DataFrame, batch_id: int) -> None:
        if every is None:
            batch.write.mode("overwrite").parquet(f"{progress_dir}/batch={batch_id}")
            return
        spark, columns = batch.sparkSession, list(batch.columns)
        step = batch.withColumn("_step", F.lit(batch_id).cast("bigint"))
        earlier = _waiting(spark, progress_dir, batch_id, step)
        # Equal rows need numbers of their own, so that each is recorded once.
        rows = materialize(step.unionByName(earlier).withColumn("_row", F.monotonically_increasing_id()))
        rank = ["_step", *(order or columns), "_row"]
        wait = rows.count() % every
        # Fewer than ``every`` rows.
        last = materialize(rows.orderBy(*[F.desc(c) for c in rank]).limit(wait))
        full = rows.join(F.broadcast(last.select("_row")), "_row", "left_anti")
        last.drop("_row").write.mode("overwrite").parquet(f"{progress_dir}/waiting/step={batch_id}")
        full.select(*columns).write.mode("overwrite").parquet(f"{progress_dir}/batch={batch_id}")

    def step(batch: DataFrame, batch_id: int) -> None:
        nonlocal enabled
        process(batch, batch_id)
        if not enabled:
            return
        try:
            record(batch, batch_id)
        except Exception as exc:  # any storage error: the copy itself must not suffer
            enabled = False
            log.warning("progress recording is off: %s", str(exc).splitlines()[0])

    return files.writeStream.foreachBatch(step)


def _waiting(spark: SparkSession, progress_dir: str, batch_id: int, like: DataFrame) -> DataFrame:
    """Rows the step before left over."""
    try:
        return spark.read.schema(like.schema).parquet(f"{progress_dir}/waiting/step={batch_id - 1}")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return like.limit(0)


def read_progress(spark: SparkSession, progress_dir: str, schema: str) -> DataFrame:
    """The recorded files, with the step that recorded each as ``batch``."""
    try:
        return spark.read.schema(f"{schema}, batch BIGINT").option("basePath", progress_dir).parquet(f"{progress_dir}/batch=*")
    except AnalysisException:
        return spark.createDataFrame([], f"{schema}, batch BIGINT")
