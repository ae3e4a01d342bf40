"""Fixed-size pages and incremental block files: bodies in rows are split with built-in expressions, stored files are read page by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.digests import u32le
from ..functions.lsn import int_div
from ..functions.naming import is_incremental_file
from ..operators.blocks import combine_chain
from ..session import materialize
from .codecs import _decoder
from .objects import _open_store, _tasks, spread_by_bytes

PAGE_BYTES = 8192
# Fixed marker at the start of an incremental file, as a little-endian number.
INCREMENTAL_MAGIC = 0x494E4352
_HEADER_BYTES = 12


def explode_blocks(contents: DataFrame, size: int = PAGE_BYTES) -> DataFrame:
    """Each body as numbered pages; a shorter last page is flagged ``partial``."""
    length = F.octet_length("content").cast("bigint")
    keep = [c for c in contents.columns if c not in ("content", "size")]
    return (
        contents.where(length > 0)
        .select(*keep, "content", F.explode(F.sequence(F.lit(0).cast("bigint"), int_div(length - 1, size))).alias("block_no"))
        .withColumn("data", F.substring("content", (F.col("block_no") * size + 1).cast("int"), F.lit(size)))
        .select(*keep, "block_no", "data", (F.octet_length("data") < size).alias("partial"))
    )


def scan_incremental_files(contents: DataFrame, size: int = PAGE_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(blocks, limits, errors)`` of incremental file bodies.

    The layout is three 32-bit numbers (marker, block count, truncation length),
    the block numbers, then the pages. Bodies that are too short or start with
    another marker become error rows.
    """
    keep = [c for c in contents.columns if c not in ("content", "size")]
    length = F.octet_length("content").cast("bigint")
    head = contents.withColumn("_magic", u32le("content", 0)).withColumn("_n", u32le("content", 4))
    error = (
        F.when(length < _HEADER_BYTES, "short header")
        .when(F.col("_magic") != INCREMENTAL_MAGIC, "bad marker")
        .when(length < _HEADER_BYTES + F.col("_n") * (4 + size), "truncated")
    )
    head = head.withColumn("error", error)
    good = head.where(F.col("error").isNull())
    limits = good.select(*keep, u32le("content", 8).alias("truncation_block_length"))
    i = F.col("_i")
    blocks = (
        good.where(F.col("_n") > 0)
        .select(*keep, "content", "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("_i"))
        .select(
            *keep,
            u32le("content", i * 4 + _HEADER_BYTES).alias("block_no"),
            F.substring(
                "content", (F.col("_n") * 4 + i * size + (_HEADER_BYTES + 1)).cast("int"), F.lit(size)
            ).alias("data"),
        )
    )
    return blocks, limits, head.where(F.col("error").isNotNull()).select(*keep, "error")


# --- chains of files on disk: numbers first, pages last ---------------------------


def target_path(path) -> Column:
    """The file an incremental file belongs to; other paths as they are."""
    return F.regexp_replace(path, r"(^|/)INCREMENTAL\.([^/]*)$", "$1$2")


_INDEX = "path STRING, chain_pos INT, location STRING, codec STRING, kind STRING, block_no BIGINT, offset BIGINT, length INT, truncation_block_length BIGINT, error STRING"
# Page numbers a task gives on at once.
_NUMBERS = 1 << 15
# Pages of whole files a task numbers.
_PAGES_PER_TASK = 1 << 21


def scan_page_index(files: DataFrame, root: str, size: int = PAGE_BYTES) -> DataFrame:
    """Where the pages of files are, without the pages: one row per page, limit or error (``kind``).

    ``files`` is ``(path, chain_pos, location, codec, size)`` with the plain size
    as the manifest has it. Of an incremental file the header is read, of another
    nothing at all: its pages follow from its size, and no Python task sees it.
    What is read of small files goes on together. ``path`` comes back as the path
    of the file the pages belong to.
    """
    open_store, decoder = _open_store(), _decoder()
    magic, header = INCREMENTAL_MAGIC, _HEADER_BYTES

    def rows(kind, numbers=(), offsets=(), lengths=(), limit=None, error=None):
        n = max(len(numbers), kind != "page")
        return kind, n, numbers, offsets, lengths, limit, error

    def of_file(stream, plain_size):
        head = stream.read(header)
        if len(head) < header:
            yield rows("error", error="short header")
            return
        found, n, limit = (int.from_bytes(head[i : i + 4], "little") for i in (0, 4, 8))
        if found != magic:
            yield rows("error", error="bad marker")
            return
        if plain_size < header + n * (4 + size):
            yield rows("error", error="truncated")
            return
        yield rows("limit", limit=limit)
        first = header + 4 * n
        for at in range(0, n, _NUMBERS):
            count = min(_NUMBERS, n - at)
            numbers = [int.from_bytes(b, "little") for b in _cut(stream.read(4 * count), 4)]
            if len(numbers) < count:
                yield rows("error", error="truncated")
                return
            yield rows("page", numbers, [first + (at + i) * size for i in range(count)], [size] * count)

    def _cut(data, width):
        return [data[i : i + width] for i in range(0, len(data) - width + 1, width)]

    def scan(batches):
        import pyarrow as pa

        store, base = open_store(root)
        decoded = decoder
        types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
        names = [x.split()[0] for x in _INDEX.split(", ")]
        held = [[] for _ in types]

        def hold(known, kind, n, numbers, offsets, lengths, limit, error):
            page, none = kind == "page", [None] * n
            columns = [*([v] * n for v in known), [kind] * n, numbers if page else none, offsets if page else none, lengths if page else none, [limit] * n, [error] * n]
            for column, values in zip(held, columns, strict=True):
                column.extend(values)

        def batch():
            full = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, types, strict=True)], names=names)
            for column in held:
                column.clear()
            return full

        def parts(location, codec, plain_size):
            try:
                with store.open_input_stream(f"{base}/{location}", compression=None) as stored:
                    if codec in (None, "", "none"):
                        yield from of_file(stored, plain_size or 0)
                    else:
                        with decoded(codec, stored) as stream:
                            yield from of_file(stream, plain_size or 0)
            except FileNotFoundError:
                yield rows("error", error="not found")
            except KeyError:
                yield rows("error", error=f"unknown codec {codec}")
            except (OSError, pa.ArrowInvalid) as exc:
                yield rows("error", error=f"decompress: {exc}")

        for files in batches:
            for path, pos, location, codec, plain_size in zip(*(files.column(c).to_pylist() for c in ("path", "chain_pos", "location", "codec", "size")), strict=True):
                for part in parts(location, codec, plain_size):
                    hold((path, pos, location, codec), *part)
                    if len(held[0]) >= _NUMBERS:
                        yield batch()
        if held[0]:
            yield batch()

    whole = ~is_incremental_file("path")
    listed = materialize(files.select(target_path(F.col("path")).alias("path"), F.col("chain_pos").cast("int").alias("chain_pos"), "location", "codec", F.col("size").cast("bigint").alias("size"), whole.alias("_whole")))
    read = spread_by_bytes(listed.where("NOT _whole").drop("_whole"), "location").mapInArrow(scan, _INDEX)
    return _whole_pages(listed.where("_whole"), size).unionByName(read)


def _whole_pages(listed: DataFrame, size: int) -> DataFrame:
    """The pages of whole files, dealt by stretches of a file, so that a large one is shared by tasks."""
    last = int_div(F.col("size") - 1, size)
    full = listed.where(F.col("size") > 0).select("path", "chain_pos", "location", "codec", "size", last.alias("_last"))
    pages = full.agg(F.coalesce(F.sum(F.col("_last") + 1), F.lit(0)).cast("bigint")).first()[0]
    tasks = max(_tasks(listed.sparkSession, per_core=4), -(-pages // _PAGES_PER_TASK))
    zero = F.lit(0).cast("bigint")
    cut = full.select("*", F.explode(F.sequence(zero, F.col("_last"), F.lit(_NUMBERS).cast("bigint"))).alias("_from")).repartition(tasks, "location", "_from")
    numbers = cut.select("*", F.explode(F.sequence("_from", F.least("_last", F.col("_from") + (_NUMBERS - 1)))).alias("block_no"))
    offset, none = F.col("block_no") * F.lit(size).cast("bigint"), F.lit(None)
    return numbers.select(
        "path", "chain_pos", "location", "codec", F.lit("page").alias("kind"), "block_no", offset.alias("offset"),
        F.least(F.lit(size).cast("bigint"), F.col("size") - offset).cast("int").alias("length"), none.cast("bigint").alias("truncation_block_length"), none.cast("string").alias("error"),
    )


def fetch_pages(wanted: DataFrame, root: str, stretch: int = 32 << 20) -> DataFrame:
    """``wanted`` with ``data``: rows ``(…, location, codec, offset, length)`` are read where they are stored.

    Rows move, pages do not: they are dealt by file and stretch of a file, sorted,
    and a task reads each stretch once from front to back. Compressed files are
    decoded up to the last page wanted of them.
    """
    open_store, decoder = _open_store(), _decoder()
    schema = T.StructType([*wanted.schema.fields, T.StructField("data", T.BinaryType())])
    plain = F.coalesce(F.col("codec"), F.lit("none")).isin("", "none")
    part = F.when(plain, int_div("offset", stretch)).otherwise(0)

    def read(batches):
        import pyarrow as pa

        store, base = open_store(root)
        stored, stream, current, at = None, None, None, 0
        for rows in batches:
            pages, held = [], 0
            columns = (rows.column(c).to_pylist() for c in ("location", "codec", "offset", "length"))
            for location, codec, offset, length in zip(*columns, strict=True):
                if location != current or offset < at:
                    for old in (stream, stored):
                        if old is not None:
                            old.close()
                    raw = codec in (None, "", "none")
                    stored = store.open_input_file(f"{base}/{location}") if raw else store.open_input_stream(f"{base}/{location}", compression=None)
                    stream, current, at = stored if raw else decoder(codec, stored), location, 0
                if stream is stored:
                    stream.seek(offset)
                else:
                    while at < offset and (skipped := len(stream.read(min(1 << 20, offset - at)))):
                        at += skipped
                page = stream.read(length)
                if len(page) != length:
                    raise OSError(f"{location}: {len(page)} of {length} bytes at {offset}")
                pages.append(page)
                at, held = offset + length, held + length
                # A batch of pages is bounded by bytes, not only by rows.
                if held >= 4 << 20:
                    done = rows.slice(0, len(pages))
                    yield pa.RecordBatch.from_arrays([*done.columns, pa.array(pages, pa.binary())], names=schema.names)
                    rows, pages, held = rows.slice(len(pages)), [], 0
            if pages or not rows.num_rows:
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(pages, pa.binary())], names=schema.names)
        for old in (stream, stored):
            if old is not None:
                old.close()

    keep = wanted.columns
    dealt = wanted.withColumn("_part", part).repartition("location", "_part").sortWithinPartitions("location", "offset")
    return dealt.select(*keep).mapInArrow(read, schema)


def combine_files(files: DataFrame, root: str, base_pos: int = 0, size: int = PAGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(pages, errors)`` of a chain of stored files, newest page first: ``(path, block_no, chain_pos, data)``.

    The chain is merged on page numbers; a page that a newer one replaces, or
    that lies past the end of its file, is never read. See ``combine_chain`` for
    the rules and ``scan_page_index`` for ``files``.
    """
    index = materialize(scan_page_index(files, root, size))
    pages = index.where("kind = 'page'").select("path", "chain_pos", "block_no", "location", "codec", "offset", "length")
    limits = index.where("kind = 'limit'").select("path", "chain_pos", "truncation_block_length")
    merged = combine_chain(pages, limits, base_pos)
    errors = index.where("kind = 'error'").select("path", "chain_pos", "location", "error")
    return fetch_pages(merged, root).select("path", "block_no", "chain_pos", "data"), errors
