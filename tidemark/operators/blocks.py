"""Blocks: changed sets, chain merge, coverage of summaries, page checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lsn import SEGMENT_BYTES, int_div
from ..joins import bounded_broadcast, latest_by, lookup, null_safe, overlay
from ..session import materialize
from .intervals import covered, first_at_levels, used_levels
from .wal import segment_gaps

_BLOCK = ["rel", "fork", "block_no"]
#: Ranges of summaries per core, and the most rows of a range while there are more of them.
RANGES_PER_CORE, MOST_ROWS = 4, 1 << 20


def block_range_check(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rows whose fork or block number is out of range."""
    ok = F.col("fork").between(0, 3) & F.col("block_no").between(0, 0xFFFFFFFF)
    return blocks.where(ok), blocks.where(~F.coalesce(ok, F.lit(False))).withColumn(
        "error", F.lit("block out of range")
    )


def changed_in_window(changed: DataFrame, start: int, end: int, tli: int | None = None, key: list[str] = _BLOCK) -> DataFrame:
    """Distinct blocks changed in ``[start, end)``, optionally of one timeline."""
    hit = (F.col("lsn") >= start) & (F.col("lsn") < end)
    if tli is not None:
        hit = hit & (F.col("tli") == tli)
    return changed.where(hit).select(*key).distinct()


def changed_in_windows(
    changed: DataFrame, windows: DataFrame, key: list[str] = _BLOCK, bucket: int = SEGMENT_BYTES
) -> DataFrame:
    """Distinct ``(window_id, block)`` for many half-open windows
    ``(window_id, tli, start_lsn, end_lsn)``.

    A block counts in a window at its first change there, the one whose change
    before it (of the same timeline) lies before the window. So every pair comes
    once by itself, and no pairs are gathered, however many a long window has.
    Positions are cut into buckets. The whole buckets of a window are covered by
    the nodes of a tree (see ``intervals``), a few hundred rows at most however
    long it is, which meet the first change of each block in a node; only the two
    edge buckets of a window meet single changes. All joins are equi joins.
    Positions are not negative.
    """
    at = windows.where(F.col("end_lsn") > F.col("start_lsn")).select("window_id", "tli", "start_lsn", "end_lsn")
    # Windows beyond the last change need no nodes there.
    top = changed.agg(F.max("lsn").cast("bigint")).first()[0]
    low, high = int_div("start_lsn", bucket), int_div("end_lsn", bucket)
    begun = F.col("start_lsn") % F.lit(bucket) != 0
    spans = at.withColumns({"_low": low + F.when(begun, 1).otherwise(0), "_high": F.least(high, F.lit((top or 0) // bucket + 1))})
    order = Window.partitionBy("tli", *key).orderBy("lsn")
    dated = changed.where(F.col("lsn").isNotNull()).select("tli", "lsn", *key, F.lag("lsn").over(order).alias("_before"))
    marked = dated.select("*", int_div("lsn", bucket).alias("_b"))
    fresh = F.col("_before").isNull() | (F.col("_before") < F.col("start_lsn"))
    # While the windows are few they travel to the changes, which then stay in place.
    nodes = covered(spans.where("_low < _high").select("window_id", "tli", "start_lsn", "_low", "_high"), "_low", "_high").drop("_low", "_high")
    per_node = first_at_levels(marked.withColumn("_last", int_div("_before", bucket)), "_b", "_last", used_levels(nodes))
    whole = per_node.join(bounded_broadcast(nodes), ["tli", "_level", "_node"]).where(fresh).select("window_id", *key)
    first, last = F.when(begun, low), F.when(F.col("end_lsn") % F.lit(bucket) != 0, high)
    ends = F.array_distinct(F.array_compact(F.array(first, last)))
    edges = marked.join(bounded_broadcast(at.select("*", F.explode(ends).alias("_b"))), ["tli", "_b"])
    edges = edges.where((F.col("lsn") >= F.col("start_lsn")) & (F.col("lsn") < F.col("end_lsn")) & fresh)
    found = whole.unionByName(edges.select("window_id", *key))
    # Several windows under one id may find a block more than once.
    repeated = at.groupBy("window_id").count().where("count > 1").limit(1).count()
    return found.distinct() if repeated else found


def newest_limits(limits: DataFrame) -> DataFrame:
    """``(path, truncation_block_length, limit_pos)`` of the newest increment of each path."""
    return latest_by(limits.withColumn("limit_pos", F.col("chain_pos")), ["path"], ["chain_pos"], ["truncation_block_length", "limit_pos"])


def _merged_chain(blocks: DataFrame, lim: DataFrame, base_pos: int) -> DataFrame:
    """The newest version of each block, with the columns of ``combine_chain``."""
    key = ["path", "block_no"]
    payload = [c for c in blocks.columns if c not in (*key, "backup_id")]
    in_range = (
        F.col("truncation_block_length").isNull()
        | (F.col("block_no") < F.col("truncation_block_length"))
        | (F.col("chain_pos") >= F.col("limit_pos"))
    )
    live = lookup(blocks, lim, ["path"]).where(in_range).select(*key, *payload)
    increments = live.where(F.col("chain_pos") > base_pos)
    values = [c for c in payload if c != "chain_pos"]
    latest = latest_by(increments, key, ["chain_pos"], values + ["chain_pos"]).withColumn("_gone", F.lit(False))
    return overlay(live.where(F.col("chain_pos") == base_pos), latest, key, "_gone").select(*key, *values, "chain_pos")


def _hole_runs(merged: DataFrame, lim: DataFrame) -> DataFrame:
    """``(path, _from, _to)``: runs of numbers below a path's limit that ``merged`` lacks."""
    within = lim.where(F.col("truncation_block_length") > 0).select("path", "truncation_block_length")
    ends = F.explode(F.array(F.lit(-1).cast("bigint"), F.col("truncation_block_length").cast("bigint")))
    below = lookup(merged.select("path", "block_no"), within, ["path"], "inner").where(F.col("block_no") < F.col("truncation_block_length"))
    known = below.select("path", F.col("block_no").cast("bigint").alias("block_no")).unionByName(within.select("path", ends.alias("block_no")))
    runs = segment_gaps(known.select(F.col("path").alias("tli"), F.col("block_no").alias("seg_no"), F.lit("segment").alias("kind")))
    return runs.select(F.col("tli").alias("path"), F.col("from_seg").alias("_from"), F.col("to_seg").alias("_to"))


def _fillers(merged: DataFrame, zero_page: bytes | None) -> list[Column]:
    """The columns of a hole besides its key."""
    filler = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in merged.schema.fields if f.name not in ("path", "block_no")}
    if "data" in filler:
        filler["data"] = F.lit(bytearray(zero_page if zero_page is not None else 8192)).alias("data")
    return list(filler.values())


def combine_chain(
    blocks: DataFrame,
    limits: DataFrame,
    base_pos: int = 0,
    fill: bool = False,
    zero_page: bytes | None = None,
    chunk: int = 1 << 16,
) -> DataFrame:
    """Merge a full backup's blocks (``chain_pos = base_pos``) with its increments.

    The newest version of each ``(path, block_no)`` wins. Blocks at or past the
    newest truncation length of their path are dropped if they are older than
    the increment that states it: what that increment carries itself was written
    after the file had been that short. Only increments are aggregated; blocks
    of the full that no increment touches pass through.
    ``fill`` adds ``zero_page`` for the holes below a path's limit, a row for
    each; ``combine_chain_runs`` has a row for each run of holes. The other
    columns move with the rows: give places of pages rather than pages, as
    ``sources.combine_files`` does.
    """
    lim = newest_limits(limits)
    merged = _merged_chain(blocks, lim, base_pos)
    if not fill:
        return merged
    # The holes are runs between blocks; only runs are shuffled, and numbers are written out where they are used.
    runs = materialize(_hole_runs(merged, lim))
    total = runs.agg(F.coalesce(F.sum(F.col("_to") - F.col("_from") + 1), F.lit(0)).cast("bigint")).first()[0]
    # Long runs are cut so that their numbers spread over the tasks; the cuts are few beside the runs.
    tasks = 8 * runs.sparkSession.sparkContext.defaultParallelism
    pieces = _cut(_cut(runs, max(chunk, -(-total // tasks))).repartition(tasks, "path", "_from"), chunk)
    holes = pieces.select("path", F.explode(F.sequence("_from", "_to")).alias("block_no"))
    return merged.unionByName(holes.select("path", "block_no", *_fillers(merged, zero_page)))


def combine_chain_runs(blocks: DataFrame, limits: DataFrame, base_pos: int = 0, zero_page: bytes | None = None) -> DataFrame:
    """``combine_chain`` with its holes as runs: a row stands for the ``n_blocks`` equal blocks from ``block_no`` on.

    A written block is a row with ``n_blocks`` 1. Paths have far more holes than
    blocks as both grow, but no more than a run of holes before each block and one
    after the last, so the rows grow with the blocks alone.
    """
    lim = materialize(newest_limits(limits))
    # Read twice: as rows, and for the runs between them.
    merged = materialize(_merged_chain(blocks, lim, base_pos))
    runs = _hole_runs(merged, lim)
    holes = runs.select("path", F.col("_from").alias("block_no"), (F.col("_to") - F.col("_from") + 1).alias("n_blocks"), *_fillers(merged, zero_page))
    return merged.withColumn("n_blocks", F.lit(1).cast("bigint")).unionByName(holes)


def _cut(runs: DataFrame, length: int) -> DataFrame:
    """Runs ``(path, _from, _to)`` in pieces of at most ``length`` numbers."""
    pieces = runs.select("path", "_to", F.explode(F.sequence("_from", "_to", F.lit(length).cast("bigint"))).alias("_from"))
    return pieces.select("path", "_from", F.least("_to", F.col("_from") + (length - 1)).alias("_to"))


def summary_gaps(
    summaries: DataFrame, start: int | None = None, end: int | None = None, bucket: int = 100_000
) -> DataFrame:
    """Stretches ``(tli, from_lsn, to_lsn)`` no summary covers.

    Without bounds the gaps between the summaries of each timeline; with bounds
    also what is missing at both ends, for all timelines that have summaries
    anywhere: one without any inside the bounds lacks all of them. Rows without a
    timeline are a timeline of their own.

    The rows are dealt by ranges of (timeline, start), sampled so that they are
    even however the rows are spread: of about ``bucket`` rows while these make no
    more than a few ranges per core, of up to ``MOST_ROWS`` beyond. Ranges are
    tasks, of which the driver hears one by one, and a long range spills. The
    running maximum is taken inside the ranges and carried from range to range by
    a second, short one.
    """
    rows = summaries.select("tli", "start_lsn", "end_lsn").where(F.col("end_lsn") > F.col("start_lsn"))
    everywhere = rows.select("tli").distinct()
    if start is not None:
        rows = rows.where(F.col("end_lsn") > start).withColumn("start_lsn", F.greatest("start_lsn", F.lit(start)))
    if end is not None:
        rows = rows.where(F.col("start_lsn") < end).withColumn("end_lsn", F.least("end_lsn", F.lit(end)))
    # Equal starts collapse, so a range never holds more rows than it has positions.
    rows = materialize(rows.groupBy("tli", "start_lsn").agg(F.max("end_lsn").alias("end_lsn")))
    n = max(rows.count(), 1)
    most = max(RANGES_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism, -(-n // MOST_ROWS))
    ranges = min(-(-n // bucket), most)
    rows = materialize(rows.repartitionByRange(ranges, "tli", "start_lsn").withColumn("_b", F.spark_partition_id()))
    before = Window.partitionBy("tli", "_b").orderBy("start_lsn").rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("_local", F.max("end_lsn").over(before))
    reach = rows.groupBy("tli", "_b").agg(F.max("end_lsn").alias("_reach"))
    earlier = Window.partitionBy("tli").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range and timeline in it.
    carry = reach.select(F.col("tli").alias("_tli"), F.col("_b").alias("_at"), F.max("_reach").over(earlier).alias("_carry"))
    covered = F.greatest("_local", "_carry", F.lit(start).cast("bigint"))
    joined = inner.join(bounded_broadcast(carry), null_safe(inner, carry, {"tli": "_tli", "_b": "_at"}))
    gaps = joined.where(F.col("start_lsn") > covered).select(
        "tli", covered.alias("from_lsn"), F.col("start_lsn").alias("to_lsn")
    )
    if end is not None:
        tail = rows.groupBy("tli").agg(F.max("end_lsn").alias("from_lsn")).where(F.col("from_lsn") < end)
        gaps = gaps.unionByName(tail.select("tli", "from_lsn", F.lit(end).cast("bigint").alias("to_lsn")))
    if start is not None and end is not None and start < end:
        inside = rows.select(F.col("tli").alias("_tli")).distinct()
        bare = everywhere.join(inside, null_safe(everywhere, inside, {"tli": "_tli"}), "left_anti")
        whole = bare.select("tli", F.lit(start).cast("bigint").alias("from_lsn"), F.lit(end).cast("bigint").alias("to_lsn"))
        gaps = gaps.unionByName(whole)
    return gaps


# --- page fingerprints ----------------------------------------------------

# Fixed starting values of the 32 lanes, in lane order.
LANES = (
    0x5B1F36E9, 0xB8525960, 0x02AB50AA, 0x1DE66D2A, 0x79F69E38, 0xD3125981, 0x6F03892E, 0xCDC9F0CC,
    0x88FB22B8, 0x21C18988, 0x2D02E5C8, 0x99025930, 0xA146C8C0, 0x3E59BFC2, 0x49C1F2BE, 0x9559E40D,
    0x4A11D5D7, 0xCE6E0066, 0xC52E50CB, 0x70CC67E1, 0x5C92AB78, 0x32E08C7F, 0xE0AAEFE0, 0x99853D2F,
    0x812DD8E2, 0xCC2B252A, 0xCA1C53FB, 0xCC2D8569, 0x07AAB95B, 0x0FA2DEB6, 0xCBC11FE9, 0xCD83BAB8,
)
# Fixed: multiplier of the hash, and where a page stores its checksum.
FNV_PRIME = 16777619
CHECKSUM_OFFSET = 8


def page_fingerprint16(blocks: DataFrame, size: int = 8192, lanes: tuple[int, ...] = LANES, final_rounds: int = 1) -> DataFrame:
    """Adds ``stored`` and ``computed`` 16-bit fingerprints to full pages.

    Both are NULL for partial pages. All pages of an Arrow batch are hashed
    together: one numpy step per word position, over pages and lanes.
    """
    fields = [f for f in blocks.schema.fields]
    schema = T.StructType([*fields, T.StructField("stored", T.IntegerType()), T.StructField("computed", T.IntegerType())])
    prime, offset = FNV_PRIME, CHECKSUM_OFFSET

    def fingerprint(batches):
        import numpy as np
        import pyarrow as pa

        seed = np.array(lanes, dtype=np.uint32)
        multiplier, shift = np.uint32(prime), np.uint32(17)
        for batch in batches:
            data, numbers = batch.column("data"), batch.column("block_no")
            whole = [i for i in range(batch.num_rows) if data[i].is_valid and data[i].as_buffer().size == size]
            stored, computed = [None] * batch.num_rows, [None] * batch.num_rows
            if whole:
                pages = np.stack([np.frombuffer(data[i].as_buffer(), dtype=np.uint8) for i in whole])
                recorded = pages[:, offset : offset + 2].copy().view("<u2")[:, 0]
                pages[:, offset : offset + 2] = 0
                words = pages.view("<u4").reshape(len(whole), -1, len(seed))
                state = np.tile(seed, (len(whole), 1))
                for step in range(words.shape[1]):
                    mixed = state ^ words[:, step, :]
                    state = (mixed * multiplier) ^ (mixed >> shift)
                for _ in range(final_rounds):
                    state = (state * multiplier) ^ (state >> shift)
                folded = np.bitwise_xor.reduce(state, axis=1)
                folded ^= np.array([numbers[i].as_py() & 0xFFFFFFFF for i in whole], dtype=np.uint32)
                result = folded % np.uint32(65535) + np.uint32(1)
                for i, s, c in zip(whole, recorded.tolist(), result.tolist()):
                    stored[i], computed[i] = s, c
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(stored, pa.int32()), pa.array(computed, pa.int32())],
                names=[f.name for f in schema.fields],
            )

    return blocks.mapInArrow(fingerprint, schema)


def page_check(blocks: DataFrame, mode: str = "strict", size: int = 8192) -> DataFrame:
    """Checked pages without their data: ``status`` is ok, failed or skipped.

    A zero stored value and a partial tail are skipped; mode ``off`` skips all.
    ``lax`` reports like ``strict``; acting on failures is up to the caller.
    """
    if mode not in ("off", "strict", "lax"):
        raise ValueError(f"unknown page check mode {mode}")
    keep = [c for c in blocks.columns if c not in ("data", "partial")]
    if mode == "off":
        none = F.lit(None).cast("int")
        return blocks.select(*keep, none.alias("stored"), none.alias("computed"), F.lit("skipped").alias("status"))
    status = (
        F.when(F.col("stored").isNull() | (F.col("stored") == 0), "skipped")
        .when(F.col("stored") == F.col("computed"), "ok")
        .otherwise("failed")
    )
    narrow = blocks.select(*keep, "data")
    return page_fingerprint16(narrow, size).select(*keep, "stored", "computed", status.alias("status"))
