"""Structured Streaming operators, run over the events table until it is drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark.session import scratch_path
from tidemark.sources.store import read_archive
from tidemark.streaming import archive_lag, fan_out_stream, ingest_stream, progress_stream, read_progress, replica_liveness, watch_required

from .registry import query
from .views import BASE_SEG, S, _seg, with_views

_EVENTS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def _stream(v: S, table: str = "events", schema: str = _EVENTS):
    # The table may be one file or a folder of files; a stream takes a single file only by a pattern.
    return v.spark.readStream.schema(schema).parquet(f"{v.dir}/{table}.parque[t]")


def _drain(writer, v: S, progress: str | None = None) -> None:
    """Run until the input is used up. State is split by the cores at hand, not by the batch default."""
    conf, key = v.spark.conf, "spark.sql.shuffle.partitions"
    before = conf.get(key)
    conf.set(key, str(min(int(before), v.spark.sparkContext.defaultParallelism)))
    try:
        job = writer.option("checkpointLocation", progress or scratch_path(v.spark, "stream")).trigger(availableNow=True).start()
        job.awaitTermination()
    finally:
        conf.set(key, before)


def _to_table(stream, v: S):
    path = scratch_path(v.spark, "out")
    _drain(stream.writeStream.format("parquet").outputMode("append").option("path", path), v)
    return v.spark.read.schema(stream.schema).parquet(path)


def _in_turns(v: S, turns: int, table: str = "events", key: str = "event_id", schema: str = _EVENTS):
    """Yields ``turns`` times a stream over the rows that arrived so far, by rising key, and the folder of its progress."""
    path, progress, k = scratch_path(v.spark, "arriving"), scratch_path(v.spark, "stream"), F.col(key)
    top = v.table(table).agg(F.max(k) + 1).scalar()
    for turn in range(turns):
        part = v.table(table).where(k * turns >= top * turn).where(k * turns < top * (turn + 1))
        part.write.mode("append").parquet(path)
        yield v.spark.readStream.schema(schema).parquet(path), progress


def _until_far(v: S, stream, other: int = -1):
    """The stream and one last row, ten years on, that lets event time pass all deadlines; ``other`` in its other columns matches nothing."""
    path = scratch_path(v.spark, "far")
    end = v.table("events").agg(F.max("ts").cast("timestamp").alias("ts")).select((F.col("ts") + F.expr("INTERVAL 10 YEARS")).alias("ts"))
    end.select(*[F.col(f.name) if f.name == "ts" else F.lit(other).cast(f.dataType).alias(f.name) for f in stream.schema.fields]).write.parquet(path)
    return stream.unionByName(v.spark.readStream.schema(stream.schema).parquet(path))


@query(with_views(
    "SELECT tli, name, arg_min(sha256, {'ts': ts, 'sha256': sha256}) AS sha256, max(size) AS size FROM v_incoming GROUP BY tli, name", "v_incoming"))
def stream_ingest(v: S):
    """Four micro-batches; the first content of a name stays, however the input is cut."""
    i, root = F.col("event_id"), scratch_path(v.spark, "archive")
    shift = F.when(i % 31 == 0, 1000000).otherwise(0)
    body = F.when(i % 29 == 0, F.concat("props", F.lit("x"))).otherwise(F.col("props"))
    for events, progress in _in_turns(v, 4):
        incoming = events.select(
            "ts", F.lit(1).cast("bigint").alias("tli"), fn.segment_name(F.lit(1), i + BASE_SEG + shift).alias("name"),
            F.sha2(body, 256).alias("sha256"), (i % 1000 + 1).alias("size"), (i + BASE_SEG + shift).alias("seg_no"),
        )
        _drain(ingest_stream(incoming, f"{root}/segments", f"{root}/side", arrived="ts"), v, progress)
    return read_archive(v.spark, f"{root}/segments").select("tli", "name", "sha256", "size")


_LAG = """SELECT event_id AS marker_id, ts AS written_at,
                 CASE WHEN event_id % 30 <> 0 AND event_id % 7 <= 5 THEN ts + (event_id % 7) * INTERVAL 1 MINUTE END AS seen_at,
                 event_id % 30 <> 0 AND event_id % 7 <= 5 AS reached FROM events"""


@query(_LAG)
def stream_archive_lag(v: S):
    """Every event is a marker; one in 30 never arrives, one in 7 too late."""
    i = F.col("event_id")
    key = [F.lit(1).cast("bigint").alias("tli"), fn.segment_name(F.lit(1), i + BASE_SEG).alias("name")]
    markers = _until_far(v, _stream(v).select(i.alias("marker_id"), *key, "ts"))
    later = F.col("ts") + F.make_dt_interval(mins=(i % 7).cast("int"))
    arrivals = _until_far(v, _stream(v).where(i % 30 != 0).select(*key, later.alias("ts")), -2)
    return _to_table(archive_lag(markers, arrivals, "5 minutes"), v)


_WATCH = f"""WITH req AS (SELECT b, seg_no, d FROM (SELECT event_id // 40 AS b, event_id + {BASE_SEG} AS seg_no, max(ts) OVER (PARTITION BY event_id // 40) + INTERVAL 10 MINUTE AS d FROM events)),
     arr AS (SELECT event_id + {BASE_SEG} AS seg_no, ts FROM events WHERE event_id % 97 <> 5),
     miss AS (SELECT b, seg_no FROM req r WHERE NOT EXISTS (SELECT 1 FROM arr a WHERE a.seg_no = r.seg_no AND a.ts <= r.d))
     SELECT b AS backup_id, 'timeout' AS status, CAST(1 AS BIGINT) AS tli, seg_no FROM miss
     UNION ALL SELECT DISTINCT b, 'complete', NULL, NULL FROM req WHERE b NOT IN (SELECT b FROM miss)
     UNION ALL SELECT -1 - n_nationkey, 'complete', NULL, NULL FROM nation"""


@query(_WATCH)
def stream_required_segments(v: S):
    """Groups of 40 segments, of which one in 97 never arrives, and groups that need none."""
    i = F.col("event_id")
    events = v.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    group = fn.int_div(i, 40)
    deadlines = events.groupBy(group.alias("backup_id")).agg((F.max("ts") + F.expr("INTERVAL 10 MINUTES")).alias("deadline"))
    required = events.select(group.alias("backup_id"), F.lit(1).cast("bigint").alias("tli"), (i + BASE_SEG).alias("seg_no")).join(deadlines, "backup_id")
    arrivals = _stream(v).where(i % 97 != 5).select(F.lit(1).cast("bigint").alias("tli"), (i + BASE_SEG).alias("seg_no"), "ts")
    idle = v.table("nation").select((-1 - F.col("n_nationkey").cast("bigint")).alias("backup_id"))
    backups = required.select("backup_id").unionByName(idle)
    return _to_table(watch_required(required, _until_far(v, arrivals), backups=backups), v)


_SAMPLE = """SELECT user_id AS host, ts, event_id % 4 <> 0 AS in_recovery, CASE WHEN event_id % 5 <> 0 THEN '0/' || event_id ELSE '' END AS replay_lsn,
                    CAST(event_id % 3 AS INTEGER) AS receivers, CASE WHEN event_id % 2 = 0 THEN 'cp' ELSE '' END AS restore_command FROM events"""
_LIVE = f"""SELECT host, s.ts AS ts, NOT s.in_recovery OR (s.replay_lsn <> '' AND (s.receivers > 0 OR s.restore_command <> '')) AS ok
            FROM (SELECT host, max({{'ts': ts, 'in_recovery': in_recovery, 'replay_lsn': replay_lsn, 'receivers': receivers, 'restore_command': restore_command}}) AS s
                  FROM ({_SAMPLE}) GROUP BY host)"""


def _samples(events):
    i = F.col("event_id")
    return events.select(
        F.col("user_id").alias("host"), F.col("ts").cast("timestamp").alias("ts"), (i % 4 != 0).alias("in_recovery"),
        F.when(i % 5 != 0, F.concat(F.lit("0/"), i)).otherwise("").alias("replay_lsn"),
        (i % 3).cast("int").alias("receivers"), F.when(i % 2 == 0, "cp").otherwise("").alias("restore_command"),
    )


@query(_LIVE)
def replica_liveness_batch(v: S):
    return replica_liveness(_samples(v.table("events")))


@query(_LIVE)
def stream_replica_liveness(v: S):
    path = scratch_path(v.spark, "live")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    _drain(replica_liveness(_samples(_stream(v))).writeStream.outputMode("update").foreachBatch(keep), v)
    updates = v.spark.read.parquet(path)
    last = updates.groupBy("host").agg(F.max("batch").alias("batch"))
    return updates.join(last, ["host", "batch"], "left_semi").select("host", "ts", "ok")


@query("SELECT event_type, count(*) AS n, CAST(2 AS BIGINT) AS copies FROM events GROUP BY event_type")
def stream_fan_out(v: S):
    root = scratch_path(v.spark, "fan")
    _drain(fan_out_stream(_stream(v).select("event_id", "event_type"), {"a": f"{root}/a", "b": f"{root}/b"}, f"{root}/status"), v)
    a, b = (v.spark.read.parquet(f"{root}/{t}").select("event_id", "event_type") for t in "ab")
    rows = a.unionByName(b)
    per_event = rows.groupBy("event_id", "event_type").agg(F.count(F.lit(1)).alias("copies"))
    return per_event.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("copies").alias("copies"))


@query("SELECT source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
def stream_progress(v: S):
    files = _stream(v, "documents", "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    path = scratch_path(v.spark, "progress")
    done = f"{path}/copied"

    def copy(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{done}/batch={batch_id}")

    _drain(progress_stream(files.select("doc_id", "source", "n_chars"), copy, f"{path}/progress"), v)
    progress = v.spark.read.parquet(f"{path}/progress")
    return progress.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("chars"))


_EVERY, _TURNS = 37, 5


@query(f"""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p, doc_id * {_TURNS} // (SELECT max(doc_id) + 1 FROM documents) AS turn FROM documents),
                t AS (SELECT turn, max(p) // {_EVERY} * {_EVERY} AS full FROM d GROUP BY turn)
           SELECT doc_id, CAST(min(t.turn) AS BIGINT) AS batch FROM d JOIN t ON d.p <= t.full GROUP BY doc_id""")
def stream_progress_groups(v: S):
    """Five steps whose files are recorded 37 at a time; those of the last, unfinished group are not."""
    path = scratch_path(v.spark, "progress")
    for files, progress in _in_turns(v, _TURNS, "documents", "doc_id", "doc_id BIGINT, source STRING, n_chars BIGINT"):
        done = lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/copied/batch={batch_id}")
        _drain(progress_stream(files, done, f"{path}/progress", every=_EVERY, order=["doc_id"]), v, progress)
    return read_progress(v.spark, f"{path}/progress", "doc_id BIGINT").select("doc_id", "batch")
