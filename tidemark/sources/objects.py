"""Object listings, bodies and archive names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import naming
from ..functions.lsn import SEGMENT_BYTES, segment_no_of_name
from ..schemas import OBJECTS
from ..session import materialize
from .codecs import DIGEST_FIELDS, digest_function


# Bytes of bodies that one task reads, about.
TASK_BYTES = 256 << 20
# What opening a file costs beside its bytes.
OPEN_BYTES = 64 << 10
# Names of one directory that one task looks at.
NAMES_PER_TASK = 50_000
# Listing rows whose sizes are summed in one window.
_ROWS_PER_CELL = 100_000


def visible_objects(objects: DataFrame, prefix: str = "", temp_marker: str | None = None) -> DataFrame:
    """Listing rules: no in-flight temporary names, no log archive at the root."""
    if temp_marker:
        objects = objects.where(~naming.basename("path").contains(temp_marker))
    if prefix:
        return objects.where(F.col("path").startswith(prefix.rstrip("/") + "/"))
    return objects.where(~F.col("path").startswith("wal/") & (F.col("path") != "wal"))


def _open_store():
    """Opens a root in a task; a closure, so that tasks need no package import."""

    def open_store(root):
        from pyarrow import fs

        if root.startswith("file:"):
            filesystem, base = fs.LocalFileSystem(), "/" + root[5:].lstrip("/")
        elif "://" in root:
            filesystem, base = fs.FileSystem.from_uri(root.replace("s3a://", "s3://", 1))
        else:
            filesystem, base = fs.LocalFileSystem(), root
        return filesystem, base.rstrip("/")

    return open_store


def _tasks(spark: SparkSession, per_core: int = 1) -> int:
    # An explicit number: AQE would judge listing rows by their few bytes and merge them
    # into one task, while each of them stands for a directory or a body to read.
    return per_core * spark.sparkContext.defaultParallelism


def _walker(root: str):
    """``walk(directory, recursive, share, shares)`` yields ``(path, size, mtime, folder)`` in a task.

    Of a directory in several shares, a task takes the names whose hash falls to
    its own; on a mounted root only those are looked at.
    """
    open_store = _open_store()

    def mounted(base, directory, recursive, mine):
        # scandir hands out entries one by one, however many a directory has.
        import os

        waiting = [directory]
        while waiting:
            folder = waiting.pop()
            try:
                entries = os.scandir(os.path.join(base, folder))
            except FileNotFoundError:
                continue
            with entries:
                for entry in entries:
                    if folder == directory and not mine(entry.name):
                        continue
                    path = f"{folder}/{entry.name}" if folder else entry.name
                    try:
                        # A link to a directory is no directory of this tree: it may lead back up.
                        if entry.is_symlink() and entry.is_dir():
                            continue
                        if entry.is_dir(follow_symlinks=False):
                            if recursive:
                                waiting.append(path)
                            else:
                                yield path, None, None, True
                        else:
                            stat = entry.stat()
                            yield path, stat.st_size, int(stat.st_mtime * 1_000_000), False
                    except FileNotFoundError:
                        continue

    def walk(directory, recursive, share, shares):
        import os
        import zlib

        from pyarrow import fs

        def mine(name):
            return shares == 1 or zlib.crc32(os.fsencode(name)) % shares == share

        store, base = open_store(root)
        if isinstance(store, fs.LocalFileSystem):
            yield from mounted(base, directory, recursive, mine)
            return
        selector = fs.FileSelector(f"{base}/{directory}" if directory else base, allow_not_found=True, recursive=recursive)
        for info in store.get_file_info(selector):
            path = info.path[len(base) + 1 :]
            if not mine(path[len(directory) + 1 if directory else 0 :].split("/", 1)[0]):
                continue
            if info.is_file:
                yield path, info.size, info.mtime_ns // 1000 if info.mtime_ns else None, False
            elif not recursive:
                yield path, None, None, True

    return walk


def _expand(root: str, recursive: bool, skip: tuple[str, ...]):
    walk = _walker(root)

    def expand(batches):
        from itertools import islice

        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            folder = batch.column("folder")
            directories = batch.filter(folder)
            yield batch.filter(pc.invert(folder))
            for directory, share, shares in zip(*(directories.column(c).to_pylist() for c in ("path", "share", "shares")), strict=True):
                found = (row for row in walk(directory, recursive, share, shares) if row[0] not in skip)
                while part := list(islice(found, 4096)):
                    path, size, mtime, is_folder = zip(*part)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(path, pa.string()),
                            pa.array(size, pa.int64()),
                            pa.array(mtime, pa.int64()).cast(pa.timestamp("us", tz="UTC")),
                            pa.array(is_folder, pa.bool_()),
                            pa.array([0] * len(part), pa.int32()),
                            pa.array([1] * len(part), pa.int32()),
                        ],
                        names=["path", "size", "mod_time", "folder", "share", "shares"],
                    )

    return expand


def _share(root: str, most: int):
    """Cuts mounted directories of more than ``most`` names into shares; counting names looks at none of them."""
    open_store = _open_store()

    def share(batches):
        import os

        import pyarrow as pa
        from pyarrow import fs

        store, base = open_store(root)
        local = isinstance(store, fs.LocalFileSystem)
        for batch in batches:
            rows, number, total = [], [], []
            for i, (path, folder) in enumerate(zip(batch.column("path").to_pylist(), batch.column("folder").to_pylist(), strict=True)):
                parts = 1
                if local and folder:
                    try:
                        with os.scandir(os.path.join(base, path)) as entries:
                            parts = max(1, -(-sum(1 for _ in entries) // most))
                    except OSError:
                        pass
                rows += [i] * parts
                number += range(parts)
                total += [parts] * parts
            known = batch.select(["path", "size", "mod_time", "folder"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*known.columns, pa.array(number, pa.int32()), pa.array(total, pa.int32())], names=[*known.schema.names, "share", "shares"])

    return share


def scan_objects(
    spark: SparkSession,
    root: str,
    prefix: str = "",
    temp_marker: str | None = None,
    inventory: DataFrame | None = None,
) -> DataFrame:
    """Recursive listing ``(path, size, mod_time)``; a missing prefix gives no rows.

    Tasks list the directories, three levels one by one and the rest recursively,
    so neither the driver nor one task holds the listing of a large repository.
    On a mounted root a directory of very many names is listed by several tasks.
    (Spark's file index would drop empty files and names starting with ``_`` or
    ``.``, which a backup has to account for.) ``inventory`` takes the place of
    the listing where the store publishes one; prefer it for object stores with
    very many objects under one prefix, which page through their keys in order.
    """
    if inventory is not None:
        return visible_objects(inventory.select("path", "size", "mod_time"), prefix, temp_marker)
    schema = OBJECTS + ", folder BOOLEAN, share INT, shares INT"
    skip = () if prefix else (naming.WAL_DIR,)
    rows = spark.createDataFrame([(prefix.strip("/"), None, None, True, 0, 1)], schema).coalesce(1)
    for recursive in (False, False, False, True):
        rows = rows.mapInArrow(_share(root, NAMES_PER_TASK), schema).repartition(_tasks(spark), "path", "share")
        rows = rows.mapInArrow(_expand(root, recursive, skip), schema)
    return visible_objects(rows.where(~F.col("folder")).drop("folder", "share", "shares"), prefix, temp_marker)


def spread_by_bytes(objects: DataFrame, location: str = "path", task_bytes: int = TASK_BYTES) -> DataFrame:
    """Rows dealt to tasks of about equal bytes, by running totals of ``size``.

    The files stand on a line of bytes, each as long as its size and what opening
    it costs, and the line is cut into equal stretches, one per task; a file goes
    where its middle lies. So a task holds at most a stretch and the halves of the
    two files that cross its ends. The totals are summed in cells of bounded
    size, dealt by hash, and then over the cells. There are as many stretches as
    the bytes ask for, and at least as many as keep all cores busy.
    """
    spark = objects.sparkSession
    weight = F.greatest(F.coalesce(F.col("size"), F.lit(0)).cast("bigint"), F.lit(0)) + OPEN_BYTES
    rows, total = objects.agg(F.count(F.lit(1)), F.coalesce(F.sum(weight), F.lit(0)).cast("bigint")).first()
    if not rows:
        return objects
    tasks = min(rows, max(_tasks(spark, per_core=4), -(-total // task_bytes)))
    cells = -(-rows // _ROWS_PER_CELL)
    placed = objects.withColumns({"_weight": weight, "_cell": F.pmod(F.xxhash64(location), F.lit(cells))})
    # One row per 100,000 files.
    starts = placed.groupBy("_cell").agg(F.sum("_weight").alias("_all"))
    starts = starts.select("_cell", (F.sum("_all").over(Window.orderBy("_cell")) - F.col("_all")).alias("_start"))
    before = F.sum("_weight").over(Window.partitionBy("_cell").orderBy(location).rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("_before", F.coalesce(before, F.lit(0))).join(F.broadcast(starts) if cells < 1 << 16 else starts, "_cell")
    middle = F.col("_start") + F.col("_before") + F.floor(F.col("_weight") / 2)
    task = F.least(F.floor(middle.cast("double") / F.lit(total / tasks)), F.lit(tasks - 1)).cast("int")
    return placed.select(*objects.columns, task.alias("_task")).repartitionById(tasks, "_task").drop("_task")


def read_bodies(objects: DataFrame, root: str) -> DataFrame:
    """``(…, content)`` of listed objects; an object that has gone meanwhile is left out.

    For bodies that fit a row, such as metadata. ``stored_digests`` streams
    bodies of any size.
    """
    spark = objects.sparkSession
    schema = T.StructType([*objects.schema.fields, T.StructField("content", T.BinaryType())])
    open_store = _open_store()

    def read(batches):
        import pyarrow as pa

        store, base = open_store(root)
        for batch in batches:
            for i in range(batch.num_rows):
                try:
                    with store.open_input_stream(f"{base}/{batch.column('path')[i].as_py()}", compression=None) as stream:
                        body = stream.read()
                except FileNotFoundError:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(i, 1).columns, pa.array([body], pa.binary())], names=schema.names
                )

    dealt = spread_by_bytes(objects) if "size" in objects.columns else objects.repartition(_tasks(spark), "path")
    return dealt.mapInArrow(read, schema)


def scan_contents(
    spark: SparkSession,
    root: str,
    prefix: str = "",
    paths: DataFrame | None = None,
    names: list[str] | None = None,
    temp_marker: str | None = None,
    objects: DataFrame | None = None,
) -> DataFrame:
    """Bodies ``(path, size, content)`` of a listing, cut down before anything is opened.

    ``names`` keeps files with these basenames, ``paths`` is a table of wanted
    paths, ``objects`` a listing that already exists.
    """
    objects = materialize(scan_objects(spark, root, prefix, temp_marker)) if objects is None else objects
    if names:
        objects = objects.where(naming.basename("path").isin(*names))
    if paths is not None:
        objects = objects.join(paths.select("path").distinct(), "path", "left_semi")
    return read_bodies(objects.select("path", "size"), root)


def stored_digests(objects: DataFrame, root: str, codec: str = "codec", location: str = "location") -> DataFrame:
    """Stored and plain size and SHA-256 of listed objects, streamed in the tasks.

    ``location`` names the column with the path below ``root``; ``codec`` the
    column with the codec. With a column ``size`` the tasks get equal bytes,
    otherwise files spread by path; so a backup that owns most objects is read by
    all tasks, and no body has to fit a row.
    """
    spark = objects.sparkSession
    schema = T.StructType([*objects.schema.fields, *DIGEST_FIELDS])
    open_store, digest_stream = _open_store(), digest_function()

    def digest(batches):
        import pyarrow as pa

        store, base = open_store(root)
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                try:
                    with store.open_input_stream(f"{base}/{batch.column(location)[i].as_py()}", compression=None) as stream:
                        found.append(digest_stream(stream, batch.column(codec)[i].as_py()))
                except FileNotFoundError:
                    found.append((None, None, None, None, "not found"))
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            cells = [pa.array([row[k] for row in found], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cells], names=schema.names)

    dealt = spread_by_bytes(objects, location) if "size" in objects.columns else objects.repartition(_tasks(spark, per_core=4), location)
    return dealt.mapInArrow(digest, schema)


def split_backup_path(objects: DataFrame) -> DataFrame:
    """``backup_id/rest`` into two columns; rows outside backup directories go."""
    return (
        objects.withColumn("backup_id", naming.backup_id_of("path"))
        .where(F.col("backup_id").isNotNull())
        .withColumn("path", F.expr("substring(path, length(backup_id) + 2)"))
    )


def scan_segments(objects: DataFrame, seg_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Classify a listing of the log archive; other files and ``.tmp`` names go."""
    base = naming.basename("path")
    named = objects.where(~base.endswith(".tmp")).withColumn("_base", base)
    name = naming.strip_sha_suffix("_base")
    kind = naming.segment_kind(name)
    seg_no = F.when(kind != "history", segment_no_of_name(name, seg_bytes))
    return named.where(kind.isNotNull()).select(
        naming.timeline_of(name).alias("tli"),
        name.alias("name"),
        kind.alias("kind"),
        seg_no.alias("seg_no"),
        naming.sha_suffix("_base").alias("sha256"),
        F.col("size"),
        F.col("path"),
    )


def filter_source_tree(objects: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Files of a data directory that a backup copies; ``max_depth`` bounds the parts of a path.

    Use :func:`split_deep` to see which paths a bound leaves out.
    """
    path = F.col("path")
    kept = objects.where(~path.startswith("pg_wal") & ~path.isin("postmaster.pid", "postmaster.opts", "pg_internal.init"))
    return kept if max_depth is None else split_deep(kept, max_depth)[0]


def split_deep(objects: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """Rows of at most ``max_depth`` path parts, and the deeper ones with an error."""
    deep = F.size(F.split("path", "/")) > max_depth
    return objects.where(~deep), objects.where(deep).withColumn("error", F.lit("path too deep"))


def split_unsafe(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Safe rows, and rows whose path is absolute or climbs out of the tree."""
    bad = naming.unsafe_path("path")
    return objects.where(~bad), objects.where(bad).withColumn("error", F.lit("unsafe path"))
