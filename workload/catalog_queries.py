"""Catalog, chains, retention, pruning, health."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark import operators as op
from tidemark.plans import plan_prune, restore_plan, verify
from tidemark.session import scratch_path
from tidemark.sources import (
    decode_sidecars,
    manifest_files,
    manifest_headers,
    read_sorted,
    scan_checkpoints,
    scan_manifests,
    scan_sidecars,
    wal_ranges,
    write_sorted,
)

from .registry import query
from .trees import TREE_SQL, documents_tree
from .views import NOW, BASE_LSN, BASE_SEG, S, _seg, with_views

DAY = 86400

# --- chains ---------------------------------------------------------------


@query(with_views(
    """SELECT b.backup_id, r.chain_id, r.depth, CASE WHEN r.chain_id IS NULL THEN 'missing_parent' ELSE 'ok' END AS status
       FROM v_backups b LEFT JOIN v_roots r ON b.backup_id = r.backup_id""",
    "v_backups", "v_roots"))
def chain_roots(v: S):
    return op.resolve_chains(v.backups())


@query(with_views(
    """SELECT b.backup_id, CASE WHEN r.depth < 4 THEN r.chain_id END AS chain_id,
              CASE WHEN r.chain_id IS NULL THEN 'missing_parent' WHEN r.depth >= 4 THEN 'too_deep' ELSE 'ok' END AS status
       FROM v_backups b LEFT JOIN v_roots r ON b.backup_id = r.backup_id""",
    "v_backups", "v_roots"))
def chain_roots_max_depth(v: S):
    return op.resolve_chains(v.backups(), max_depth=4).drop("depth")


@query(with_views(
    """SELECT b.backup_id, b.parent_backup_id, 'missing_parent' AS reason FROM v_backups b
       WHERE b.type = 'incremental' AND NOT EXISTS (SELECT 1 FROM v_backups p WHERE p.backup_id = b.parent_backup_id)""",
    "v_backups"))
def orphans(v: S):
    return op.orphans(v.backups())


# --- retention ------------------------------------------------------------

_KEEP = {
    "keep_fulls": "SELECT backup_id, 'keep_fulls' AS reason FROM (SELECT backup_id FROM v_fulls ORDER BY stop_time DESC, backup_id LIMIT {n})",
    "keep_full_age": f"SELECT backup_id, 'keep_full_age' AS reason FROM v_fulls WHERE stop_time > TIMESTAMP '{NOW}' - INTERVAL {{n}} DAY",
    "keep_daily": "SELECT arg_min(backup_id, (-epoch_us(stop_time), backup_id)), 'keep_daily' FROM v_fulls WHERE day_no BETWEEN 0 AND {n} - 1 GROUP BY day_no",
    "keep_weekly": "SELECT arg_min(backup_id, (-epoch_us(stop_time), backup_id)), 'keep_weekly' FROM v_fulls WHERE week_no BETWEEN 0 AND {n} - 1 GROUP BY week_no",
    "keep_monthly": "SELECT arg_min(backup_id, (-epoch_us(stop_time), backup_id)), 'keep_monthly' FROM v_fulls WHERE month_no BETWEEN 0 AND {n} - 1 GROUP BY month_no",
}


def _kept_sql(**rules: int) -> str:
    hits = " UNION ALL ".join("(" + _KEEP[name].format(n=n) + ")" for name, n in rules.items())
    return f"v_hits(chain_id, reason) AS ({hits}), v_kept AS (SELECT chain_id, string_agg(reason, ',' ORDER BY reason) AS reasons FROM v_hits GROUP BY chain_id)"


def _plan_sql(select: str | None = None, **rules: int) -> str:
    select = select or (
        "SELECT r.backup_id, r.chain_id, k.reasons IS NOT NULL AS kept, coalesce(k.reasons, '') AS reasons"
        " FROM v_roots r LEFT JOIN v_kept k USING (chain_id)"
    )
    return with_views("SELECT 1", "v_backups", "v_roots", "v_fulls").removesuffix("SELECT 1").rstrip() + ", " + _kept_sql(**rules) + " " + select


def _policy(**rules: int) -> op.Policy:
    if "keep_full_age" in rules:
        rules["keep_full_age"] *= DAY
    return op.Policy(now=NOW, **rules)


def _plan(v: S, **rules: int):
    return op.retention_plan(v.backups(), _policy(**rules)).withColumn("reasons", F.array_join("reasons", ","))


@query(_plan_sql(keep_fulls=25))
def retention_keep_n(v: S):
    return _plan(v, keep_fulls=25)


@query(_plan_sql(keep_full_age=30))
def retention_age(v: S):
    return _plan(v, keep_full_age=30)


@query(_plan_sql(keep_daily=14))
def retention_daily(v: S):
    return _plan(v, keep_daily=14)


@query(_plan_sql(keep_weekly=12))
def retention_weekly(v: S):
    return _plan(v, keep_weekly=12)


@query(_plan_sql(keep_monthly=12))
def retention_monthly(v: S):
    return _plan(v, keep_monthly=12)


@query(_plan_sql(keep_fulls=5, keep_full_age=10, keep_daily=7, keep_weekly=8, keep_monthly=24))
def retention_all_rules(v: S):
    return _plan(v, keep_fulls=5, keep_full_age=10, keep_daily=7, keep_weekly=8, keep_monthly=24)


@query(with_views(
    """SELECT server, backup_id FROM (SELECT server, backup_id, row_number() OVER (PARTITION BY server ORDER BY stop_time DESC, backup_id) AS rn
       FROM v_fulls) WHERE rn <= 3""", "v_backups", "v_fulls"))
def newest_chains_per_server(v: S):
    fulls = v.backups().where(F.col("type") == "full")
    return fulls.join(op.newest_chains(fulls, 3, "server"), "backup_id", "left_semi").select("server", "backup_id")


@query(_plan_sql("SELECT min(start_lsn) AS low_water_lsn, CAST(NULL AS VARCHAR) AS reason FROM v_fulls WHERE backup_id IN (SELECT chain_id FROM v_kept)", keep_fulls=25))
def low_water(v: S):
    b = v.backups()
    return op.low_water(b, op.kept_fulls(b, _policy(keep_fulls=25)))


# --- prune ----------------------------------------------------------------

_V_OBJECTS = """v_objects AS (SELECT CAST(l_orderkey AS VARCHAR) AS backup_id,
    l_orderkey || '/' || CASE WHEN l_linenumber = 1 THEN 'backup_manifest' ELSE 'base/' || l_partkey END AS path,
    CAST(l_quantity AS BIGINT) AS size, l_linenumber FROM lineitem)"""


def _objects(v: S):
    rest = F.when(F.col("l_linenumber") == 1, "backup_manifest").otherwise(F.concat(F.lit("base/"), F.col("l_partkey")))
    return v.table("lineitem").select(
        F.concat_ws("/", F.col("l_orderkey").cast("string"), rest).alias("path"), F.col("l_quantity").cast("bigint").alias("size")
    )


def _text_plan(v: S):
    return _plan(v, keep_monthly=24).withColumn("backup_id", F.col("backup_id").cast("string"))


@query(_plan_sql(keep_monthly=24, select=
    "SELECT backup_id, path, size, CASE WHEN l_linenumber = 1 THEN 0 ELSE 1 END AS delete_order FROM v_objects"
    " WHERE backup_id IN (SELECT CAST(backup_id AS VARCHAR) FROM v_roots WHERE chain_id NOT IN (SELECT chain_id FROM v_kept))"
).replace("v_hits(", _V_OBJECTS + ", v_hits(", 1))
def prune_objects(v: S):
    return op.prune_objects(_text_plan(v), _objects(v))


@query(with_views(
    """SELECT tli, name, seg_no, sha256, size FROM v_segments WHERE seg_no <
       (SELECT min(start_lsn) FROM v_backups WHERE type = 'full' AND backup_id % 3 = 0 AND backup_id > 1000) // 16777216""",
    "v_backups", "v_segments"))
def prune_segments(v: S):
    kept = v.backups().where((F.col("backup_id") % 3 == 0) & (F.col("backup_id") > 1000)).select(F.col("backup_id").alias("chain_id"))
    water = op.low_water(v.backups(), kept).select("low_water_lsn").scalar()
    return op.prune_segments(v.segments(), water).drop("kind")


@query(with_views(
    f"""SELECT s.tli, s.seg_no, s.sha256 FROM (SELECT event_id % 5 + 1 AS tli, event_id + {BASE_SEG} AS seg_no, sha256(props) AS sha256 FROM events) s
       JOIN (SELECT o_custkey % 4 + 1 AS tli, min(start_lsn) // 16777216 AS cut FROM v_backups JOIN orders ON o_orderkey = backup_id
             WHERE backup_id > 2000 GROUP BY 1) c USING (tli) WHERE s.seg_no < c.cut""", "v_backups"))
def prune_segments_per_timeline(v: S):
    i = F.col("event_id")
    segments = v.table("events").select(
        (i % 5 + 1).alias("tli"), (i + BASE_SEG).alias("seg_no"), F.sha2("props", 256).alias("sha256"), F.lit("segment").alias("kind")
    )
    orders = v.table("orders").select(F.col("o_orderkey").alias("backup_id"), (F.col("o_custkey") % 4 + 1).alias("tli"))
    starts = v.backups().where(F.col("backup_id") > 2000).join(orders, "backup_id").groupBy("tli").agg(F.min("start_lsn").alias("low_water_lsn"))
    return op.prune_segments(segments, starts, per_timeline=True).drop("kind")


@query(_plan_sql(keep_monthly=24, select=
    """SELECT 'backups' AS kind, count(*) AS n FROM v_roots WHERE chain_id NOT IN (SELECT chain_id FROM v_kept)
       UNION ALL SELECT 'objects', count(*) FROM v_objects WHERE backup_id IN
         (SELECT CAST(backup_id AS VARCHAR) FROM v_roots WHERE chain_id NOT IN (SELECT chain_id FROM v_kept))
       UNION ALL SELECT 'segments', count(*) FROM v_segments WHERE seg_no <
         (SELECT min(start_lsn) // 16777216 FROM v_fulls WHERE backup_id IN (SELECT chain_id FROM v_kept))"""
).replace("v_hits(", _V_OBJECTS + ", " + with_views("", "v_segments").removeprefix("WITH RECURSIVE ").rstrip() + ", v_hits(", 1))
def prune_summary(v: S):
    # Padded ids sort as text the way the numbers sort, so ties break alike in both engines.
    b = v.backups().withColumns({c: F.lpad(F.col(c).cast("string"), 12, "0") for c in ("backup_id", "parent_backup_id")})
    objects = _objects(v).withColumn("path", F.concat(F.lpad(F.substring_index("path", "/", 1), 12, "0"), F.expr("substring(path, instr(path, '/'))")))
    return plan_prune(b, objects, v.segments(), _policy(keep_monthly=24)).summary


# --- catalog --------------------------------------------------------------


@query("SELECT 's' || n_nationkey AS server, (SELECT count(*) FROM orders WHERE o_orderkey % 101 <> 50 AND o_custkey % 10 = n_nationkey) AS backups FROM nation")
def server_inventory(v: S):
    roots = v.table("nation").select(F.concat(F.lit("s"), F.col("n_nationkey")).alias("server"))
    return op.server_inventory(v.backups(), roots)


@query(with_views("SELECT * FROM v_backups WHERE server = 's3'", "v_backups"))
def filter_server(v: S):
    return op.filter_server(v.backups(), "s3")


@query(with_views(
    """SELECT server, max(CAST(backup_id AS VARCHAR)) AS by_text,
              arg_max(backup_id, (stop_time, backup_id)) AS by_time FROM v_backups GROUP BY server""", "v_backups"))
def latest_backups(v: S):
    b = v.backups()
    text = op.latest_backups(b.withColumn("backup_id", F.col("backup_id").cast("string")), "lexicographic")
    return text.withColumnRenamed("backup_id", "by_text").join(
        op.latest_backups(b).withColumnRenamed("backup_id", "by_time"), "server"
    )


@query(with_views(
    """SELECT p.server, p.backup_id, l.latest_id, coalesce(p.backup_id <= l.latest_id, false) AS collides
       FROM (SELECT 's' || (c_custkey % 12) AS server, c_custkey * 12 AS backup_id FROM customer) p
       LEFT JOIN (SELECT server, max(backup_id) AS latest_id FROM v_backups GROUP BY server) l USING (server)""", "v_backups"))
def label_collisions(v: S):
    proposed = v.table("customer").select(
        F.concat(F.lit("s"), F.col("c_custkey") % 12).alias("server"), (F.col("c_custkey") * 12).alias("backup_id")
    )
    return op.label_collisions(proposed, v.backups())


@query(with_views(
    """SELECT s.server, s.latest_backup, s.recorded_id, c.current_id, coalesce(s.recorded_id = c.current_id, true) AS ok,
              coalesce(s.lo <> s.hi, false) AS several_ids
       FROM (SELECT server, arg_max(backup_id, (stop_time, backup_id)) AS latest_backup,
                    arg_max(CASE WHEN sid <> 0 THEN sid ELSE -1 END, (stop_time, backup_id)) AS raw,
                    CASE WHEN raw <> -1 THEN raw END AS recorded_id,
                    min(nullif(sid, 0)) AS lo, max(nullif(sid, 0)) AS hi
             FROM (SELECT *, CAST(substr(server, 2) AS BIGINT) % 4 + (backup_id % 1000) // 999 AS sid FROM v_backups) GROUP BY server) s
       LEFT JOIN (SELECT 's' || r_regionkey AS server, nullif(CAST(r_regionkey AS BIGINT) % 3, 0) AS current_id FROM region) c USING (server)""",
    "v_backups"))
def identity_check(v: S):
    sid = F.substring("server", 2, 9).cast("bigint") % 4 + fn.int_div(F.col("backup_id") % 1000, 999)
    b = v.backups().withColumn("system_identifier", sid.cast("decimal(20,0)"))
    current = v.table("region").select(
        F.concat(F.lit("s"), F.col("r_regionkey")).alias("server"), (F.col("r_regionkey") % 3).cast("decimal(20,0)").alias("current_id")
    )
    out = op.identity_check(b, current)
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("recorded_id", "current_id")})


@query("""SELECT o_orderkey AS backup_id, CASE WHEN c_custkey IS NULL THEN o_orderpriority WHEN c_custkey % 2 = 0 THEN c_name END AS annotation
          FROM orders LEFT JOIN customer ON c_custkey = o_orderkey""")
def update_annotation(v: S):
    catalog = v.table("orders").select(F.col("o_orderkey").alias("backup_id"), F.col("o_orderpriority").alias("annotation"))
    note = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("")
    return op.update_annotation(catalog, v.table("customer").select(F.col("c_custkey").alias("backup_id"), note.alias("annotation")))


@query("SELECT DISTINCT CAST(o_orderkey AS VARCHAR) || 'F' AS backup_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 2 = 0")
def distinct_backup_ids(v: S):
    k = F.col("l_orderkey")
    path = F.concat(k.cast("string"), F.when(k % 2 == 0, "F/").otherwise("X/"), F.col("l_partkey").cast("string"))
    orders = v.table("orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return op.distinct_backup_ids(v.table("lineitem").join(orders, "l_orderkey", "left_semi").select(path.alias("path")))


@query(with_views(
    """SELECT m.backup_id, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, min(ts) AS start_time, max(ts) AS stop_time,
              any_value(r.timeline) AS timeline, any_value(r.start_lsn) AS start_lsn, any_value(r.stop_lsn) AS stop_lsn
       FROM (SELECT backup_id, size, TIMESTAMP '2001-01-01 00:00:00' + doc_id * INTERVAL 1 MINUTE AS ts FROM v_manifest) m
       JOIN (SELECT source, min(doc_id) % 3 AS timeline, min(doc_id) * 10 AS start_lsn, max(doc_id) * 10 AS stop_lsn FROM documents GROUP BY source) r
         ON r.source = m.backup_id GROUP BY m.backup_id""", "v_manifest"))
def catalog_header(v: S):
    start = F.lit("2001-01-01 00:00:00").cast("timestamp")
    files = v.manifest().withColumn("mod_time", start + F.make_dt_interval(mins=F.col("doc_id").cast("int")))
    ranges = v.table("documents").groupBy(F.col("source").alias("backup_id")).agg(
        F.lit(0).alias("idx"),
        (F.min("doc_id") % 3).alias("timeline"),
        (F.min("doc_id") * 10).alias("start_lsn"),
        (F.max("doc_id") * 10).alias("end_lsn"),
    )
    return op.manifest_header(files, ranges)


# --- metadata decoding ----------------------------------------------------


def _lsn_sql(x: str) -> str:
    return f"printf('%X/%X', ({x}) // 4294967296, ({x}) % 4294967296)"


@query(with_views(
    """SELECT backup_id, k % 59 <> 0 AS readable, k % 53 <> 0 AND k % 59 <> 0 AS checksum_ok,
              CASE WHEN k % 59 <> 0 THEN '18446744073709551615' END AS system_identifier,
              CASE WHEN k % 59 <> 0 THEN 2 END AS n_files
       FROM v_repo WHERE k % 43 <> 0""", "v_repo"))
def scan_manifest_documents(v: S):
    m = scan_manifests(v.repo_contents())
    return m.select(
        "backup_id", "readable", "checksum_ok", F.col("system_identifier").cast("string").alias("system_identifier"),
        F.when(F.col("files").isNotNull(), F.size("files")).alias("n_files"),
    )


@query(with_views(
    """SELECT backup_id, 'base/' || k AS path, k % 5000 AS size, sha256(CAST(k AS VARCHAR)) AS sha256, o_orderdate AS mod_time FROM v_repo WHERE k % 43 <> 0 AND k % 59 <> 0
       UNION ALL SELECT backup_id, 'global/é', 10, NULL, TIMESTAMP '2001-01-01 00:00:00' FROM v_repo WHERE k % 43 <> 0 AND k % 59 <> 0""", "v_repo"))
def manifest_file_rows(v: S):
    return manifest_files(scan_manifests(v.repo_contents())).drop("incremental")


@query(with_views(
    """SELECT backup_id, 0 AS idx, k % 3 + 1 AS timeline, start_lsn, start_lsn + 20000000 AS end_lsn FROM v_repo WHERE k % 43 <> 0 AND k % 59 <> 0""", "v_repo"))
def wal_range_rows(v: S):
    return wal_ranges(scan_manifests(v.repo_contents()))


_SIDECAR_OK = "k % 47 <> 0 AND k % 61 <> 0 AND k % 67 <> 0 AND k % 71 <> 0"
_SHA_BYTES = "lower(list_reduce([printf('%02X', (k + i) % 256) for i in range(32)], lambda a, b: a || b))"


@query(with_views(
    f"""SELECT backup_id, 3 AS version, 's' || (o_custkey % 10) AS server, CASE WHEN k % 2 = 0 THEN 'zstd' ELSE 'none' END AS codec,
               CAST(k % 5 AS VARCHAR) AS system_identifier,
               CASE WHEN k % 6 <> 0 THEN CASE WHEN incremental THEN 'incremental' ELSE 'full' END END AS type,
               {_SHA_BYTES} AS segment_sha
        FROM v_repo WHERE {_SIDECAR_OK}""", "v_repo"))
def scan_sidecar_documents(v: S):
    good, _ = scan_sidecars(v.repo_contents())
    return good.select(
        "backup_id", "version", "server", "codec", F.col("system_identifier").cast("string").alias("system_identifier"), "type",
        F.col("wal_segments")[0]["sha256"].alias("segment_sha"),
    )


@query(with_views(
    """SELECT backup_id, CASE WHEN k % 67 = 0 THEN 'invalid JSON'
              WHEN k % 61 = 0 AND k % 71 = 0 THEN 'unknown field: surprise, extra'
              WHEN k % 61 = 0 THEN 'unknown field: surprise' ELSE 'unknown field: extra' END AS error
       FROM v_repo WHERE k % 47 <> 0 AND (k % 61 = 0 OR k % 67 = 0 OR k % 71 = 0)""", "v_repo"))
def sidecar_warnings(v: S):
    return scan_sidecars(v.repo_contents())[1]


_HEADER_OK = "k % 43 <> 0 AND k % 59 <> 0"

# An id carries six digits of its key, so ids repeat in tables of more than a million keys: what
# belongs to a backup is found by its id, as the operator does, not by the key it was made from.
_SIDECARS = f"""v_sidecars AS (SELECT *, CASE WHEN {_SIDECAR_OK} THEN NULL WHEN k % 67 = 0 THEN 'invalid JSON'
           WHEN k % 61 = 0 AND k % 71 = 0 THEN 'unknown field: surprise, extra'
           WHEN k % 61 = 0 THEN 'unknown field: surprise' ELSE 'unknown field: extra' END AS error FROM v_repo WHERE k % 47 <> 0),
       v_warnings AS (SELECT backup_id, CASE WHEN s.k IS NULL THEN 'sidecar missing' ELSE s.error END AS error
           FROM (SELECT DISTINCT backup_id FROM v_repo) LEFT JOIN v_sidecars s USING (backup_id) WHERE s.k IS NULL OR s.error IS NOT NULL)"""
_CATALOG = f"""{_SIDECARS},
       v_headers AS (SELECT backup_id, k % 3 + 1 AS timeline, start_lsn, start_lsn + 20000000 AS stop_lsn,
           least(o_orderdate, TIMESTAMP '2001-01-01') AS start_time, greatest(o_orderdate, TIMESTAMP '2001-01-01') AS stop_time,
           CAST(2 AS BIGINT) AS files, k % 5000 + 10 AS bytes FROM v_repo WHERE {_HEADER_OK}),
       v_catalog AS (SELECT s.backup_id, s.incremental, s.parent, 's' || (s.o_custkey % 10) AS server,
           h.timeline, h.start_lsn, h.stop_lsn, h.start_time, h.stop_time, h.files, h.bytes
           FROM v_sidecars s LEFT JOIN v_headers h USING (backup_id) WHERE s.error IS NULL)"""


@query(with_views(
    f""", {_CATALOG}
        SELECT backup_id, CASE WHEN incremental THEN 'incremental' ELSE 'full' END AS type,
               CASE WHEN incremental THEN parent END AS parent_backup_id, server,
               timeline, start_lsn, stop_lsn, start_time, stop_time, files, bytes FROM v_catalog""", "v_repo"))
def build_catalog(v: S):
    return _catalog(v)[0].drop("compression", "recipients", "annotation", "system_identifier")


def _catalog(v: S):
    contents = v.repo_contents()
    return op.build_catalog(v.repo_objects(), decode_sidecars(contents), manifest_headers(scan_manifests(contents)))


@query(with_views(f", {_SIDECARS} SELECT backup_id, error FROM v_warnings", "v_repo"))
def catalog_warnings(v: S):
    return _catalog(v)[1]


@query(with_views(
    f""", {_CATALOG}
        SELECT 0 AS ord, 'storage_reachable' AS name, true AS ok,
               (SELECT count(*) FROM v_repo) + (SELECT count(*) FROM v_repo WHERE k % 43 <> 0) + (SELECT count(*) FROM v_repo WHERE k % 9 = 0) || ' objects listed' AS detail, false AS all_ok
        UNION ALL SELECT 1, 'info_decodable', n = 0, n || ' sidecar(s) failed to decode', false FROM (SELECT count(*) AS n FROM v_warnings)
        UNION ALL SELECT 2, 'chain_integrity', n = 0, n || ' orphan(s)', false FROM (SELECT count(*) AS n FROM v_catalog c
          WHERE incremental AND NOT EXISTS (SELECT 1 FROM v_catalog p WHERE p.backup_id = c.parent))
        UNION ALL SELECT 3, 'wal_expected', true, count(*) || ' segments archived', false FROM v_segments
        UNION ALL SELECT 4, 'archive_command', true, 'skipped', false
        UNION ALL SELECT 5, 'standby_coordination', n = 0, CASE WHEN n = 0 THEN 'ok' ELSE n || ' standby host(s) disconnected' END, false
          FROM (SELECT count(*) AS n FROM customer WHERE c_custkey % 3 = 0)""", "v_repo", "v_segments"))
def health_report(v: S):
    backups, warnings = _catalog(v)
    standby = v.table("customer").select((F.col("c_custkey") % 3 != 0).alias("ok"))
    return op.health_report(v.repo_objects(), backups, warnings, v.segments(), standby=standby)


# --- resume ---------------------------------------------------------------

_GATE = op.Gate(tool_version="1.0", backup_type="full", compression="zstd", system_identifier=7, recipients=("a", "b"))


@query(with_views(
    """, u AS (SELECT backup_id FROM v_repo GROUP BY backup_id HAVING bool_and(k % 3 <> 0)),
       c AS (SELECT * FROM v_repo WHERE NOT (k % 14 = 0 OR k % 10 = 4)),
       j AS (SELECT backup_id, CASE WHEN c.k IS NULL THEN 'corrupt'
                WHEN TIMESTAMP '2001-08-02 12:00:00' - c.o_orderdate > INTERVAL 700 DAY THEN 'expired'
                WHEN c.k % 8 = 6 OR c.k % 5 = 0 OR c.k % 2 <> 0 THEN 'mismatch' END AS r FROM u LEFT JOIN c USING (backup_id)),
       m AS (SELECT max(backup_id) AS newest FROM j WHERE r IS NULL)
       SELECT backup_id, CASE WHEN r IN ('corrupt', 'expired') THEN 'reap' WHEN r IS NULL AND backup_id = newest THEN 'resume' ELSE 'leave' END AS action,
              coalesce(r, CASE WHEN backup_id = newest THEN 'newest' ELSE 'superseded' END) AS reason FROM j, m""", "v_repo"))
def find_resumable(v: S):
    checkpoints, _, _ = scan_checkpoints(v.run_contents())
    return op.find_resumable(v.run_objects(), checkpoints, _GATE, 700 * DAY, NOW)


@query(with_views(
    """SELECT backup_id, CASE WHEN k % 8 = 6 THEN '1.1' ELSE '1.0' END AS tool_version,
              CASE WHEN k % 5 = 0 THEN 'gzip' ELSE 'zstd' END AS compression, CAST(7 + k % 2 AS VARCHAR) AS system_identifier, k AS start_lsn, o_orderdate AS checkpointed_at
       FROM v_repo WHERE k % 14 <> 0 AND k % 10 <> 4""", "v_repo"))
def scan_checkpoint_documents(v: S):
    c, _, _ = scan_checkpoints(v.run_contents())
    return c.select("backup_id", "tool_version", "compression", F.col("system_identifier").cast("string").alias("system_identifier"), "start_lsn", "checkpointed_at")


@query(with_views(
    """SELECT backup_id, 'base/1' AS path, nullif(k % 100, 0) AS repo_size,
              lower(list_reduce([printf('%02X', (k * 3 + i) % 256) for i in range(32)], lambda a, b: a || b)) AS repo_sha256
       FROM v_repo WHERE k % 14 <> 0 AND k % 10 <> 4""", "v_repo"))
def checkpoint_file_rows(v: S):
    return scan_checkpoints(v.run_contents())[1].select("backup_id", "path", "repo_size", "repo_sha256")


@query(with_views(
    """SELECT backup_id, CASE WHEN k % 14 = 0 THEN 'invalid JSON' ELSE 'unsupported checkpoint version' END AS error
       FROM v_repo WHERE (k % 14 = 0 OR k % 10 = 4)""", "v_repo"))
def corrupt_checkpoints(v: S):
    return scan_checkpoints(v.run_contents())[2]


_REUSE_CTE = """WITH d AS (SELECT doc_id, text, 'b' || (doc_id // 10) AS backup_id,
         CASE WHEN doc_id % 59 = 0 THEN 'backup_label' ELSE 'base/' || doc_id END AS path FROM documents),
     s AS (SELECT doc_id, backup_id, path, CASE
         WHEN doc_id % 59 = 0 THEN 'denied'
         WHEN doc_id % 47 = 0 OR strlen(text) + (doc_id % 43 = 0)::INT = 0 THEN 'no_digest'
         WHEN doc_id % 41 = 0 THEN 'missing'
         WHEN (doc_id % 43 = 0)::INT <> (doc_id % 37 = 0)::INT THEN 'size_differs'
         WHEN doc_id % 37 = 0 OR (doc_id % 53 = 0 AND contains(text, 'e')) THEN 'hash_differs'
         WHEN doc_id % 61 = 0 THEN 'source_changed' ELSE 'reusable' END AS status FROM d)
"""


def _reuse(v: S):
    from tidemark.sources import content_digests

    t = v.reuse_tables()
    # Bodies are read for size survivors only; the semi join filters before hashing.
    survivors = op.size_survivors(t["files"], t["objects"])
    bodies = t["contents"].join(survivors, ["backup_id", "path"], "left_semi")
    return op.reusable_objects(t["files"], t["objects"], content_digests(bodies, compressed=False), t["source"]), t


@query(_REUSE_CTE + "SELECT backup_id, path, status FROM s")
def reusable_objects(v: S):
    return _reuse(v)[0].select("backup_id", "path", "status")


@query(_REUSE_CTE + """SELECT path, 'copy' AS what FROM s WHERE path <> 'backup_label' AND status <> 'reusable'
                       UNION ALL SELECT path, 'keep' FROM s WHERE status = 'reusable'""")
def pending_files(v: S):
    reuse, t = _reuse(v)
    copy, keep = op.pending_files(t["source"], reuse)
    return copy.select("path", F.lit("copy").alias("what")).unionByName(keep.select("path", F.lit("keep").alias("what")))


# --- restore plan, totals, replicas ---------------------------------------


@query(with_views(
    """, target AS (SELECT arg_max(backup_id, (stop_time, backup_id)) AS id FROM v_backups),
       chain AS (SELECT b.backup_id, b.parent_backup_id, b.type FROM v_backups b, target WHERE b.backup_id = target.id
                 UNION ALL SELECT p.backup_id, p.parent_backup_id, p.type FROM v_backups p JOIN chain c ON c.type <> 'full' AND p.backup_id = c.parent_backup_id),
       ordered AS (SELECT backup_id, CAST(row_number() OVER (ORDER BY backup_id) - 1 AS INTEGER) AS seq FROM chain)
       SELECT seq, 'file' AS kind, CAST(o.backup_id AS VARCHAR) AS backup_id, v.path, v.size FROM ordered o JOIN v_objects v ON v.backup_id = CAST(o.backup_id AS VARCHAR)
       UNION ALL SELECT 1048576, 'wal', NULL, name, size FROM v_segments WHERE seg_no >= (SELECT start_lsn // 16777216 FROM v_backups, target WHERE backup_id = id)""",
    "v_backups", "v_segments").replace("WITH RECURSIVE ", "WITH RECURSIVE " + _V_OBJECTS + ", ", 1))
def restore_plan_latest(v: S):
    b = v.backups().withColumns({c: F.col(c).cast("string") for c in ("backup_id", "parent_backup_id")})
    # Text ids order differently from numbers; pick the latest by number, as the oracle does.
    latest = v.backups().agg(F.max_by("backup_id", F.struct("stop_time", "backup_id"))).first()[0]
    return restore_plan(b, _objects(v), v.segments().withColumn("path", F.col("name")), str(latest), wal="needed")


@query(with_views(
    """SELECT (SELECT count(*) FROM v_manifest) AS files, CAST((SELECT sum(size) FROM v_manifest) AS BIGINT) AS bytes,
              (SELECT count(*) FROM v_segments) AS segments, CAST((SELECT sum(size) FROM v_manifest) AS DOUBLE) / 20 AS bytes_per_second""",
    "v_manifest", "v_segments"))
def run_totals(v: S):
    return op.run_totals(v.manifest(), v.segments(), seconds=20)


@query("""SELECT o_custkey AS backup_id, bool_or(o_orderstatus = 'F') AS complete, count(*) FILTER (o_orderstatus = 'F') AS committed,
                 count(*) FILTER (o_orderstatus <> 'F') AS failed FROM orders GROUP BY 1""")
def replica_status(v: S):
    return op.replica_status(v.table("orders").select(
        F.col("o_custkey").alias("backup_id"), F.when(F.col("o_orderstatus") == "F", "committed").otherwise("failed").alias("status")
    ))


# --- sorted outputs -----------------------------------------------------------


def _through_file(v: S, rows, order):
    path = scratch_path(v.spark, "sorted")
    write_sorted(rows, path, order)
    return read_sorted(v.spark, path)


@query(with_views("SELECT row_number() OVER (ORDER BY stop_time, backup_id) - 1 AS position, backup_id, type, stop_time FROM v_backups", "v_backups"))
def sorted_catalog(v: S):
    """The catalog oldest first, written and read back with the positions of its rows."""
    return _through_file(v, v.backups().select("backup_id", "type", "stop_time"), ["stop_time", "backup_id"])


@query(with_views("SELECT row_number() OVER (ORDER BY rel, fork, block_no) - 1 AS position, rel, fork, block_no FROM (SELECT DISTINCT rel, fork, block_no FROM v_changed)", "v_changed"))
def sorted_blocks(v: S):
    """Changed blocks by file, fork and number, written and read back with the positions of their rows."""
    return _through_file(v, v.changed().select("rel", "fork", "block_no").distinct(), ["rel", "fork", "block_no"])


# --- verification of a repository on disk ------------------------------------


@query(f"""SELECT backup_id, 'base/' || d || CASE WHEN status = 'EXTRA' THEN 'x' ELSE '' END AS path, status
           FROM ({TREE_SQL}) WHERE status NOT IN ('OK', 'ENCRYPTED')""")
def verify_repository(v: S):
    """Every file that is not as recorded, in a tree of plain, gzip and zstd files."""
    return verify(v.spark, documents_tree(v), full=True)[1].select("backup_id", "path", "status")


@query(f"""WITH t AS ({TREE_SQL}), ids AS (SELECT DISTINCT '2026010' || (doc_id % 6 + 1) || 'T000000F' AS backup_id, doc_id % 6 + 1 AS n FROM documents)
           SELECT backup_id, count(*) FILTER (status = 'OK') AS files_ok, count(*) FILTER (status NOT IN ('OK', 'ENCRYPTED')) AS files_mismatched,
                  count(*) FILTER (status = 'ENCRYPTED') AS files_encrypted, n <> 4 AS manifest_checksum_ok,
                  CASE WHEN n = 6 THEN 'UNREADABLE' WHEN n = 4 OR count(*) FILTER (status NOT IN ('OK', 'ENCRYPTED')) > 0 THEN 'FAILED'
                       WHEN count(*) FILTER (status = 'ENCRYPTED') > 0 THEN 'ENCRYPTED' ELSE 'OK' END AS status
           FROM ids LEFT JOIN t USING (backup_id, n) GROUP BY backup_id, n""")
def verify_repository_summary(v: S):
    return verify(v.spark, documents_tree(v), full=True)[0]
