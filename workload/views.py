"""Deterministic views that turn the provided tables into repository tables.

``S`` holds the Spark side, ``SQL`` the same views as DuckDB CTE bodies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark.session import materialize

NOW = "2001-08-02 12:00:00"
BASE_LSN = 12335146074112
BASE_SEG = BASE_LSN // fn.SEGMENT_BYTES


class S:
    """Views of one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def backups(self) -> DataFrame:
        k = F.col("o_orderkey")
        full = k % 7 == 0
        start = k * 5000000 + (BASE_LSN + 40)
        return self.table("orders").where(k % 101 != 50).select(
            k.alias("backup_id"),
            F.when(full, "full").otherwise("incremental").alias("type"),
            F.when(~full, k - 1).alias("parent_backup_id"),
            F.concat(F.lit("s"), F.col("o_custkey") % 10).alias("server"),
            start.alias("start_lsn"),
            (start + 20000000).alias("stop_lsn"),
            F.lit(1).cast("bigint").alias("timeline"),
            F.col("o_orderdate").cast("timestamp").alias("stop_time"),
        )

    def segments(self) -> DataFrame:
        e = self.table("events").where(F.col("event_id") % 11 != 5)
        first = e.select("event_id", F.sha2("props", 256).alias("sha256"))
        second = e.where(F.col("event_id") % 97 == 0).select("event_id", F.sha2("event_type", 256).alias("sha256"))
        return first.unionByName(second).select(
            F.lit(1).cast("bigint").alias("tli"),
            fn.segment_name(F.lit(1), F.col("event_id") + BASE_SEG).alias("name"),
            F.lit("segment").alias("kind"),
            (F.col("event_id") + BASE_SEG).alias("seg_no"),
            "sha256",
            (F.col("event_id") % 1000 + 1).alias("size"),
        )

    def incoming(self) -> DataFrame:
        i = F.col("event_id")
        shift = F.when(i % 31 == 0, 1000000).otherwise(0)
        body = F.when(i % 29 == 0, F.concat("props", F.lit("x"))).otherwise(F.col("props"))
        rows = self.table("events").select(
            F.lit(1).cast("bigint").alias("tli"),
            fn.segment_name(F.lit(1), i + BASE_SEG + shift).alias("name"),
            F.sha2(body, 256).alias("sha256"),
            (i % 1000 + 1).alias("size"),
            i.alias("event_id"),
            F.col("ts").cast("timestamp").alias("ts"),
        )
        return rows

    def manifest(self) -> DataFrame:
        return self.table("documents").select(
            F.col("source").alias("backup_id"),
            F.concat(F.lit("base/"), F.col("doc_id")).alias("path"),
            F.octet_length("text").cast("bigint").alias("size"),
            F.sha2("text", 256).alias("sha256"),
            "doc_id",
        )

    def stored(self) -> DataFrame:
        d = F.col("doc_id")
        body = F.when(d % 37 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
        return self.table("documents").where(d % 41 != 0).select(
            F.col("source").alias("backup_id"),
            F.concat(F.lit("base/"), d).alias("path"),
            F.encode(body, "UTF-8").alias("content"),
            d.alias("doc_id"),
        )

    def current(self) -> DataFrame:
        c, k = self.table("customer"), F.col("c_custkey")
        kept = c.where(k % 17 != 0).withColumn(
            "c_acctbal", F.when(k % 13 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
        )
        return kept.unionByName(c.where(k % 19 == 0).withColumn("c_custkey", k + 1000000))

    def blocks(self) -> DataFrame:
        return (
            self.table("lineitem")
            .groupBy(
                F.col("l_suppkey").alias("path"),
                F.col("l_partkey").alias("block_no"),
                F.col("l_linenumber").alias("chain_pos"),
            )
            .agg(F.max("l_extendedprice").alias("value"))
        )

    def limits(self) -> DataFrame:
        n = self.table("part").agg(F.count(F.lit(1)).alias("n"))
        length = fn.int_div(n.select(F.col("n") * 3).scalar(), 4)
        even = self.table("supplier").where(F.col("s_suppkey") % 2 == 0).select(F.col("s_suppkey").alias("path"))
        return even.select("path", F.lit(1).alias("chain_pos"), F.lit(10).cast("bigint").alias("truncation_block_length")).unionByName(
            even.select("path", F.lit(2).alias("chain_pos"), length.alias("truncation_block_length"))
        )

    def changed(self) -> DataFrame:
        return self.table("lineitem").select(
            F.lit(1).cast("bigint").alias("tli"),
            F.col("l_suppkey").alias("rel"),
            (F.col("l_linenumber") % 4).alias("fork"),
            F.col("l_partkey").alias("block_no"),
            (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("lsn"),
        )

    def windows(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.table("supplier").select(
            k.alias("window_id"),
            F.lit(1).cast("bigint").alias("tli"),
            (k * 30000).alias("start_lsn"),
            (k * 30000 + 100000 + (k % 7) * 20000).alias("end_lsn"),
        )

    def changes(self) -> DataFrame:
        i = F.col("event_id")
        return self.table("events").select(
            "user_id",
            i.alias("lsn"),
            fn.int_div(i, 7).alias("xid"),
            F.when(i % 1000 == 999, F.concat(F.lit("rp"), fn.int_div(i, 1000))).alias("restore_point"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.when(F.col("event_type") == "error", "D").otherwise("U").alias("op"),
            "value",
        )

    def base(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value"))

    def summaries(self) -> DataFrame:
        i = F.col("event_id")
        start = i * 50 + F.when(i % 11 == 0, 10_000_000).otherwise(0)  # timeline 4 begins late
        return self.table("events").select(
            F.when(i % 11 == 0, 4).otherwise(i % 3 + 1).cast("bigint").alias("tli"), start.alias("start_lsn"), (start + 40 + (i % 7) * 20).alias("end_lsn")
        )

    # --- a repository made of metadata bodies, three objects per backup ----

    def repo_ids(self) -> DataFrame:
        """Ids, dates and flags of the synthetic backups."""
        k = F.col("o_orderkey")
        incremental = k % 4 == 3
        own = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("T"), F.lpad((k % 1000000).cast("string"), 6, "0"))
        parent = F.concat(own, F.lit("F"))
        return self.table("orders").select(
            "o_orderkey",
            "o_custkey",
            F.col("o_orderdate").cast("timestamp").alias("o_orderdate"),
            "o_orderpriority",
            F.when(incremental, F.concat(parent, F.lit("_"), own, F.lit("I"))).otherwise(parent).alias("backup_id"),
            parent.alias("parent"),
            incremental.alias("incremental"),
        )

    def _spread(self, ids: DataFrame) -> DataFrame:
        """One small file feeds much work per row here; use all cores for it."""
        return ids.repartition(self.spark.sparkContext.defaultParallelism, "o_orderkey")

    def repo_contents(self) -> DataFrame:
        """``(path, size, content)`` of manifests and sidecars; some are missing or broken."""
        k = F.col("o_orderkey")
        ids = self._spread(self.repo_ids())
        start = k * 5000000 + 40
        files = F.format_string(
            '"Files": [\n{ "Path": "base/%d", "Size": %d, "Last-Modified": "%s GMT", "Checksum-Algorithm": "SHA256", "Checksum": "%s" },\n'
            '{ "Path": "global/é", "Size": 10, "Last-Modified": "2001-01-01 00:00:00 GMT" }\n],\n',
            k, k % 5000, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.sha2(k.cast("string"), 256),
        )
        head = F.concat(
            F.lit('{ "PostgreSQL-Backup-Manifest-Version": 2,\n"System-Identifier": 18446744073709551615,\n'),
            files,
            F.format_string(
                '"WAL-Ranges": [\n{ "Timeline": %d, "Start-LSN": "%s", "End-LSN": "%s" }\n],\n',
                k % 3 + 1, fn.format_lsn(start), fn.format_lsn(start + 20000000),
            ),
        )
        digest = F.when(k % 53 == 0, F.sha2("backup_id", 256)).otherwise(F.sha2(head, 256))
        manifest = F.concat(head, F.format_string('"Manifest-Checksum": "%s"}\n', digest))
        manifest = F.when(k % 59 == 0, "{ not json").otherwise(manifest)
        sidecar = F.format_string(
            '{"version": 3, "server": "s%d", "encryption_recipients": null, "compression": "%s",'
            ' "storage_layout_version": 1, "wal_segments": [{"name": "x", "size": 1, "sha256": [%s]%s}],'
            ' "system_identifier": %d, "directories": [], "type": "%s"%s}',
            F.col("o_custkey") % 10,
            F.when(k % 2 == 0, "zstd:3").otherwise(""),
            F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: ((k + i) % 256).cast("string")), ","),
            F.when(k % 71 == 0, ', "extra": 1').otherwise(""),
            k % 5,
            F.when(k % 6 == 0, "").otherwise(F.when(F.col("incremental"), "incremental").otherwise("full")),
            F.when(k % 61 == 0, ', "surprise": true').otherwise(""),
        )
        sidecar = F.when(k % 67 == 0, "not valid json").otherwise(sidecar)
        parts = [
            ids.where(k % 43 != 0).select("backup_id", F.lit("backup_manifest").alias("f"), manifest.alias("t")),
            ids.where(k % 47 != 0).select("backup_id", F.lit("Storage-Metadata.json").alias("f"), sidecar.alias("t")),
        ]
        rows = parts[0].unionByName(parts[1]).select(
            F.concat_ws("/", "backup_id", "f").alias("path"), F.encode("t", "UTF-8").alias("content")
        )
        # Stands for bodies read from a store: written out once, then only read.
        return materialize(rows).withColumn("size", F.octet_length("content").cast("bigint"))

    def repo_objects(self) -> DataFrame:
        ids = self.repo_ids()
        k = F.col("o_orderkey")
        version = ids.select(F.concat_ws("/", "backup_id", F.lit("PG_VERSION")).alias("path"), F.lit(3).cast("bigint").alias("size"))
        metadata = ids.where(k % 43 != 0).select(F.concat_ws("/", "backup_id", F.lit("backup_manifest")).alias("path"), F.lit(1).cast("bigint").alias("size"))
        other = ids.where(k % 9 == 0).select(F.concat(F.lit("lost+found/"), k).alias("path"), F.lit(1).cast("bigint").alias("size"))
        return version.unionByName(metadata).unionByName(other)

    # --- interrupted runs ---------------------------------------------------

    def run_objects(self) -> DataFrame:
        k, ids = F.col("o_orderkey"), self.repo_ids()
        copies = ids.select(F.concat_ws("/", "backup_id", F.lit("backup_manifest.copy")).alias("path"))
        done = ids.where(k % 3 == 0).select(F.concat_ws("/", "backup_id", F.lit("backup_manifest")).alias("path"))
        return copies.unionByName(done).withColumn("size", F.lit(1).cast("bigint"))

    def run_contents(self) -> DataFrame:
        k = F.col("o_orderkey")
        array32 = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: ((k * 3 + i) % 256).cast("string")), ",")
        text = F.format_string(
            '{"version": %d, "tool_version": "%s", "backup_id": "%s", "backup_type": "full", "parent_backup_id": "",'
            ' "compression": "%s", "encryption_recipients": ["a","b"], "system_identifier": %d, "timeline": 1,'
            ' "start_lsn": %d, "start_time": "2001-01-01T00:00:00Z", "checkpointed_at": "%sZ",'
            ' "files": [{"path": "base/1", "size": 5, "sha256": [%s], "mod_time": "2001-01-01T00:00:00Z",'
            ' "repo_size": %d, "repo_sha256": [%s]}]}',
            F.when(k % 10 == 4, 2).otherwise(1),
            F.when(k % 8 == 6, "1.1").otherwise("1.0"),
            "backup_id",
            F.when(k % 5 == 0, "gzip").otherwise("zstd"),
            F.lit(7) + k % 2,
            k,
            F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"),
            array32,
            k % 100,
            array32,
        )
        text = F.when(k % 14 == 0, F.substring(text, 1, 40)).otherwise(text)
        rows = self._spread(self.repo_ids()).select(
            F.concat_ws("/", "backup_id", F.lit("backup_manifest.copy")).alias("path"), F.encode(text, "UTF-8").alias("content")
        )
        return materialize(rows)

    def reuse_tables(self) -> dict[str, DataFrame]:
        d = F.col("doc_id")
        docs = self.table("documents").select(
            "doc_id",
            "text",
            F.concat(F.lit("b"), fn.int_div(d, 10)).alias("backup_id"),
            F.when(d % 59 == 0, "backup_label").otherwise(F.concat(F.lit("base/"), d)).alias("path"),
            F.sha2("text", 256).alias("sha"),
            F.octet_length("text").cast("bigint").alias("len"),
        )
        body = (
            F.when(d % 37 == 0, F.concat("text", F.lit("!")))
            .when(d % 53 == 0, F.translate("text", "e", "i"))
            .otherwise(F.col("text"))
        )
        stored = docs.where(d % 41 != 0).select("backup_id", "path", F.encode(body, "UTF-8").alias("content"))
        return {
            "files": docs.select(
                "backup_id", "path", F.col("len").alias("size"), F.col("sha").alias("sha256"),
                (F.col("len") + F.when(d % 43 == 0, 1).otherwise(0)).alias("repo_size"),
                F.when(d % 47 != 0, F.col("sha")).alias("repo_sha256"),
            ),
            "objects": stored.select("backup_id", "path", F.octet_length("content").cast("bigint").alias("size")),
            "contents": stored,
            "source": docs.where(F.col("path") != "backup_label").select(
                "path",
                F.when(d % 61 == 0, F.sha2(F.concat("text", F.lit("?")), 256)).otherwise(F.col("sha")).alias("sha256"),
            ),
        }


_SEG = "printf('%08X%08X%08X', 1, ({n}) // 256, ({n}) % 256)"


def _seg(n: str) -> str:
    return _SEG.format(n=n)


SQL: dict[str, str] = {
    "v_backups": f"""
        SELECT o_orderkey AS backup_id,
               CASE WHEN o_orderkey % 7 = 0 THEN 'full' ELSE 'incremental' END AS type,
               CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey - 1 END AS parent_backup_id,
               's' || (o_custkey % 10) AS server,
               {BASE_LSN} + o_orderkey * 5000000 + 40 AS start_lsn,
               {BASE_LSN} + o_orderkey * 5000000 + 40 + 20000000 AS stop_lsn,
               CAST(1 AS BIGINT) AS timeline, o_orderdate AS stop_time
        FROM orders WHERE o_orderkey % 101 <> 50""",
    "v_roots": """
        SELECT backup_id, backup_id AS chain_id, CAST(0 AS BIGINT) AS depth FROM v_backups WHERE type = 'full'
        UNION ALL
        SELECT b.backup_id, r.chain_id, r.depth + 1 FROM v_backups b JOIN v_roots r ON b.parent_backup_id = r.backup_id""",
    "v_fulls": f"""
        SELECT *, date_diff('day', CAST(stop_time AS DATE), DATE '{NOW[:10]}') AS day_no,
               date_diff('day', CAST(stop_time AS DATE) - CAST(dayofweek(stop_time) AS INTEGER),
                         DATE '{NOW[:10]}' - CAST(dayofweek(DATE '{NOW[:10]}') AS INTEGER)) // 7 AS week_no,
               (2001 * 12 + 8) - (year(stop_time) * 12 + month(stop_time)) AS month_no
        FROM v_backups WHERE type = 'full'""",
    "v_segments": f"""
        SELECT CAST(1 AS BIGINT) AS tli, {_seg(f'event_id + {BASE_SEG}')} AS name, 'segment' AS kind,
               event_id + {BASE_SEG} AS seg_no, sha256, event_id % 1000 + 1 AS size
        FROM (SELECT event_id, sha256(props) AS sha256 FROM events WHERE event_id % 11 <> 5
              UNION ALL
              SELECT event_id, sha256(event_type) FROM events WHERE event_id % 11 <> 5 AND event_id % 97 = 0)""",
    "v_incoming": f"""
        SELECT CAST(1 AS BIGINT) AS tli,
               {_seg(f'event_id + {BASE_SEG} + CASE WHEN event_id % 31 = 0 THEN 1000000 ELSE 0 END')} AS name,
               sha256(CASE WHEN event_id % 29 = 0 THEN props || 'x' ELSE props END) AS sha256,
               event_id % 1000 + 1 AS size, event_id, ts
        FROM events""",
    "v_manifest": """
        SELECT source AS backup_id, 'base/' || doc_id AS path, CAST(strlen(text) AS BIGINT) AS size,
               sha256(text) AS sha256, doc_id FROM documents""",
    "v_stored": """
        SELECT source AS backup_id, 'base/' || doc_id AS path,
               sha256(CASE WHEN doc_id % 37 = 0 THEN text || '!' ELSE text END) AS sha256
        FROM documents WHERE doc_id % 41 <> 0""",
    "v_current": """
        SELECT c_custkey, c_name, c_nationkey,
               CASE WHEN c_custkey % 13 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment
        FROM customer WHERE c_custkey % 17 <> 0
        UNION ALL
        SELECT c_custkey + 1000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 19 = 0""",
    "v_blocks": """
        SELECT l_suppkey AS path, l_partkey AS block_no, l_linenumber AS chain_pos, max(l_extendedprice) AS value
        FROM lineitem GROUP BY ALL""",
    "v_limit": """
        SELECT s_suppkey AS path, (SELECT count(*) * 3 // 4 FROM part) AS truncation_block_length
        FROM supplier WHERE s_suppkey % 2 = 0""",
    "v_changed": """
        SELECT CAST(1 AS BIGINT) AS tli, l_suppkey AS rel, l_linenumber % 4 AS fork, l_partkey AS block_no,
               l_orderkey * 1000 + l_linenumber AS lsn FROM lineitem""",
    "v_windows": """
        SELECT s_suppkey AS window_id, s_suppkey * 30000 AS start_lsn,
               s_suppkey * 30000 + 100000 + (s_suppkey % 7) * 20000 AS end_lsn FROM supplier""",
    "v_changes": """
        SELECT user_id, event_id AS lsn, event_id // 7 AS xid,
               CASE WHEN event_id % 1000 = 999 THEN 'rp' || (event_id // 1000) END AS restore_point,
               ts, CASE WHEN event_type = 'error' THEN 'D' ELSE 'U' END AS op, value FROM events""",
    "v_summaries": """
        SELECT tli, start_lsn, start_lsn + 40 + (event_id % 7) * 20 AS end_lsn
        FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 4 ELSE event_id % 3 + 1 END AS tli,
                     event_id * 50 + CASE WHEN event_id % 11 = 0 THEN 10000000 ELSE 0 END AS start_lsn FROM events)""",
    "v_repo": """
        SELECT o_orderkey AS k, o_custkey, o_orderdate,
               strftime(o_orderdate, '%Y%m%d') || 'T' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') || 'F' AS parent,
               CASE WHEN o_orderkey % 4 = 3
                    THEN strftime(o_orderdate, '%Y%m%d') || 'T' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') || 'F_'
                         || strftime(o_orderdate, '%Y%m%d') || 'T' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') || 'I'
                    ELSE strftime(o_orderdate, '%Y%m%d') || 'T' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') || 'F'
               END AS backup_id,
               o_orderkey % 4 = 3 AS incremental,
               o_orderkey * 5000000 + 40 AS start_lsn
        FROM orders""",
}


def with_views(select: str, *names: str) -> str:
    """``select`` preceded by the named views as CTEs."""
    body = ",\n".join(f"{n} AS ({SQL[n]})" for n in names)
    return f"WITH RECURSIVE {body}\n{select}" if select.lstrip()[:1] != "," else f"WITH RECURSIVE {body}{select}"
