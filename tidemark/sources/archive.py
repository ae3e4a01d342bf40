"""The log archive: one content per segment name, however many writers push at once.

Layout: ``<archive>/tli=<T>/range=<R>/gen=<G>/<version>.parquet``. A range holds
neighbouring names, at most 65,536 segments. Its files are numbered without
gaps, and a file is published whole under the next free number by *create if
absent*. A writer decides which of its names are new from all files up to the
last one it knows; if another writer takes the number first, it reads that file
and decides again. So of two contents of one name pushed at the same time one is
stored, and the other writer is told of a conflict. A failed attempt means that
somebody else has got on, so no writer waits for one that died.

Each range is settled by the task that holds its rows; a push costs the ranges it
touches, and nothing else of the archive is listed or read.

When a generation has ``compact_after`` files, its next number is taken by an
empty file, which closes it; then file 0 of the next generation holds all its
rows. Whoever finds a closed generation without a successor completes it, and
both come to the same rows. Readers take the newest generation of each range;
``vacuum_archive`` removes the older ones.

On mounted file systems a file is published by a hard link. For object stores
hand in ``claim``, a function that puts bytes under a key unless it exists (a
conditional put) and tells whether it did.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..joins import bounded_broadcast
from ..session import materialize
from .objects import _open_store

Claim = Callable[[str, bytes], bool]

COMPACT_AFTER = 64
#: Names that are no segment names are spread over so many ranges.
OTHER_RANGES = 1024
#: Listings with a gap before a range counts as damaged.
_LISTINGS = 500
NO_TIMELINE = "__HIVE_DEFAULT_PARTITION__"

SCHEMA = "name STRING, sha256 STRING, size BIGINT, batch STRING, tli BIGINT, range STRING, gen INT"


def name_range(name: Column) -> Column:
    """The range of a name: the upper digits of a segment's position, or a hash for other names."""
    segment = F.coalesce(name.rlike("^[0-9A-F]{24}"), F.lit(False))
    other = F.pmod(F.crc32(F.coalesce(name, F.lit(""))), F.lit(OTHER_RANGES))
    return F.when(segment, F.concat(F.lit("r"), F.substring(name, 9, 6))).otherwise(F.format_string("x%03X", other))


# --- files of one range, in a task ---------------------------------------------


def _range_files(archive: str, claim: Claim | None):
    """Builds, in a task, the access to the files of ranges."""
    open_store = _open_store()

    class Files:
        def __init__(self):
            from pyarrow import fs

            self.store, self.base = open_store(archive.rstrip("/"))
            self.mounted = isinstance(self.store, fs.LocalFileSystem)
            if not self.mounted and claim is None:
                raise ValueError("pushing to an object store needs a function that puts a key if it is absent")

        def names(self, folder: str) -> list[str]:
            from pyarrow import fs

            found = self.store.get_file_info(fs.FileSelector(f"{self.base}/{folder}", allow_not_found=True))
            return [x.base_name for x in found]

        def read(self, path: str):
            import pyarrow.parquet as pq

            with self.store.open_input_file(f"{self.base}/{path}") as source:
                return pq.ParquetFile(source).read()

        def create(self, path: str, table) -> bool:
            """Publishes a whole file unless the name is taken."""
            import os
            import uuid

            import pyarrow as pa
            import pyarrow.parquet as pq

            sink = pa.BufferOutputStream()
            pq.write_table(table, sink)
            body = sink.getvalue().to_pybytes()
            if not self.mounted:
                return claim(f"{archive.rstrip('/')}/{path}", body)
            target = f"{self.base}/{path}"
            staged = f"{self.base}/_staged/{uuid.uuid4().hex}"
            for folder in (os.path.dirname(target), os.path.dirname(staged)):
                os.makedirs(folder, exist_ok=True)
            with open(staged, "xb") as out:
                out.write(body)
                out.flush()
                os.fsync(out.fileno())
            try:
                os.link(staged, target)
            except FileExistsError:
                return False
            finally:
                os.unlink(staged)
            return True

    return Files


def _newest(files, folder: str) -> tuple[int, int]:
    """(newest generation, files in it); (0, 0) for a range that is not there."""
    import time

    for _ in range(_LISTINGS):
        generations = sorted((int(n[4:]) for n in files.names(folder) if n.startswith("gen=")), reverse=True)
        for gen in generations:
            versions = sorted(int(n[:8]) for n in files.names(f"{folder}/gen={gen}") if n.endswith(".parquet"))
            # A listing made while files appear may miss one; then it has a gap.
            if versions != list(range(len(versions))):
                time.sleep(0.01)
                break
            if versions:
                return gen, len(versions)
        else:
            return 0, 0
    raise OSError(f"{folder}: a file of the newest generation is missing")


def _settle(files, folder: str, pushed: list[tuple], owner: str, compact_after: int) -> dict:
    """Stores the pushed (name, sha256, size) whose name is new; {name: (sha256, owner)} of the pushed names."""
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = pa.schema([("name", pa.string()), ("sha256", pa.string()), ("size", pa.int64()), ("batch", pa.string())])
    names = pa.array([r[0] for r in pushed], pa.string())
    at, read, known, kept = -1, 0, {}, []
    while True:
        gen, versions = _newest(files, folder)
        if gen != at:
            at, read, known, kept = gen, 0, {}, []
        closed = False
        for number in range(read, versions):
            table = files.read(f"{folder}/gen={gen}/{number:08d}.parquet")
            closed = not table.num_rows
            kept.append(table)
            # Rows of other names are only handed on, as a table.
            table = table.filter(pc.is_in(table["name"], value_set=names))
            known.update(zip(table["name"].to_pylist(), zip(table["sha256"].to_pylist(), table["batch"].to_pylist(), strict=True), strict=True))
        read = versions
        if closed:
            kept = [pa.concat_tables(kept)]
            files.create(f"{folder}/gen={gen + 1}/{0:08d}.parquet", kept[0])
            # Whoever wrote that file, it holds the rows that are known here.
            at, read = gen + 1, 1
            continue
        fresh = [r for r in pushed if r[0] not in known]
        if fresh:
            columns = [pa.array(c, t) for c, t in zip([*zip(*fresh, strict=True), [owner] * len(fresh)], rows.types, strict=True)]
            if files.create(f"{folder}/gen={gen}/{versions:08d}.parquet", pa.table(columns, schema=rows)):
                known.update((n, (s, owner)) for n, s, _ in fresh)
                if versions + 1 >= compact_after:
                    files.create(f"{folder}/gen={gen}/{versions + 1:08d}.parquet", rows.empty_table())
                    pushed = []
                else:
                    return known
            continue
        return known


def _committer(archive: str, owner: str, compact_after: int, claim: Claim | None):
    make = _range_files(archive, claim)

    def commit(key, table):
        import pyarrow as pa

        tli, name_range = key[0].as_py(), key[1].as_py()
        columns = [table.column(c).to_pylist() for c in ("name", "sha256", "size")]
        pushed = sorted(zip(*columns, strict=True), key=lambda r: (r[0] is None, r[0] or ""))
        known = _settle(make(), f"tli={NO_TIMELINE if tli is None else tli}/range={name_range}", pushed, owner, compact_after)
        asked = [r[0] for r in pushed]
        return pa.table(
            {
                "tli": pa.array([tli] * len(asked), pa.int64()),
                "name": pa.array(asked, pa.string()),
                "_held": pa.array([known[n][0] for n in asked], pa.string()),
                "_mine": pa.array([known[n][1] == owner for n in asked], pa.bool_()),
            }
        )

    return commit


# --- the archive as a table ------------------------------------------------------


def _files(spark: SparkSession, archive: str) -> DataFrame:
    """Rows of all generations."""
    try:
        return spark.read.schema(SCHEMA).parquet(archive.rstrip("/"))
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def _current(rows: DataFrame) -> DataFrame:
    """Rows of the newest generation of each range; only compacted ranges are read to tell which that is."""
    newest = rows.where("gen > 0").groupBy("tli", "range").agg(F.max("gen").alias("_newest"))
    newest = bounded_broadcast(newest.withColumnsRenamed({"tli": "_tli", "range": "_range"}))
    on = rows["tli"].eqNullSafe(newest["_tli"]) & (rows["range"] == newest["_range"])
    return rows.join(newest, on, "left").where(F.col("gen") == F.coalesce("_newest", F.lit(0)))


def read_archive(spark: SparkSession, archive: str, names: tuple[str, str] | None = None) -> DataFrame:
    """``(name, sha256, size, batch, tli)`` of the stored segments.

    ``names``, the first and last wanted segment name, leaves other ranges unread.
    """
    rows = _files(spark, archive)
    if names is not None:
        low, high = (f"r{n[8:14]}" for n in names)
        rows = rows.where(F.col("range").between(low, high) & F.col("name").between(*names))
    return _current(rows).select("name", "sha256", "size", "batch", "tli")


def archive_ingest(
    incoming: DataFrame, archive: str, batch: str, arrived: str | None = None, compact_after: int = COMPACT_AFTER, claim: Claim | None = None
) -> DataFrame:
    """Add the new segments of one batch; returns ``(tli, name, sha256, copies, status)`` per pushed content.

    new: stored by this batch. duplicate: this very content was stored before.
    conflict: the name holds other content; such rows are returned and never
    written. Of several contents of a new name the first is taken, by the column
    ``arrived`` if there is one and then by hash.

    Any number of writers may push at the same time, under batch ids of their own
    or the same one. Stored rows carry the id and the print of the batch, so a
    batch that is replayed, or a task that is repeated, finds its rows and calls
    them new again.
    """
    spark = incoming.sparkSession
    moment = F.min(arrived) if arrived else F.lit(0)
    # Repeats collapse first; everything below reads this reduced batch.
    pushed = materialize(
        incoming.groupBy("tli", "name", "sha256").agg(
            F.count(F.lit(1)).alias("copies"), F.max("size").alias("size"), moment.alias("_arrived")
        )
    )
    row = F.xxhash64("tli", "name", "sha256", "size")
    mark = pushed.agg(F.count(F.lit(1)), F.bit_xor(row), F.sum(row.cast("decimal(38,0)"))).first()
    owner = f"{batch}.{hashlib.sha256(repr(tuple(mark)).encode()).hexdigest()[:16]}"
    first = pushed.groupBy(F.col("tli").cast("bigint").alias("tli"), "name").agg(
        F.min_by(F.struct("sha256", F.col("size").cast("bigint").alias("size")), F.struct("_arrived", "sha256")).alias("_first")
    )
    # At most one row per name is left, so a range is bounded whatever was pushed.
    asked = first.select("tli", name_range(F.col("name")).alias("_range"), "name", "_first.sha256", "_first.size")
    commit = _committer(archive, owner, compact_after, claim)
    held = asked.groupBy("tli", "_range").applyInArrow(commit, "tli bigint, name string, _held string, _mine boolean")
    held = materialize(held).withColumnsRenamed({"tli": "_tli", "name": "_name"})
    on = pushed["tli"].eqNullSafe(held["_tli"]) & pushed["name"].eqNullSafe(held["_name"])
    same = F.col("sha256").eqNullSafe(F.col("_held"))
    status = F.when(~same, "conflict").when(F.col("_mine"), "new").otherwise("duplicate")
    verdict = pushed.join(bounded_broadcast(held), on)
    return materialize(verdict.select("tli", "name", "sha256", "copies", status.alias("status")))


def vacuum_archive(spark: SparkSession, archive: str, dry_run: bool = True) -> DataFrame:
    """``path`` of files of older generations; deleted if ``dry_run`` is off.

    Run it when no reader that started before the last compaction is left.
    """
    files = _files(spark, archive).select("tli", "range", "gen", F.col("_metadata.file_path").alias("path")).distinct()
    newest = files.groupBy("tli", "range").agg(F.max("gen").alias("_newest"))
    newest = newest.withColumnsRenamed({"tli": "_tli", "range": "_range"})
    on = files["tli"].eqNullSafe(newest["_tli"]) & (files["range"] == newest["_range"])
    old = materialize(files.join(newest, on).where(F.col("gen") < F.col("_newest")).select("path"))
    if not dry_run:
        open_store = _open_store()

        def delete(batches):
            from urllib.parse import unquote

            for batch in batches:
                for path in batch.column("path").to_pylist():
                    store, base = open_store(unquote(path))
                    store.delete_file(base)
                yield batch

        old.mapInArrow(delete, "path string").foreach(lambda _: None)
    return old
