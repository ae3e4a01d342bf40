"""Document fingerprints by content-defined chunking.

A gear hash over the last ``WINDOW`` bytes marks cut points; the cuts are
normalised: up to ``NORMAL`` bytes after a cut a strict mask must match, then a
loose one, never before ``LEAST`` and at the latest after ``MOST`` bytes. A
fingerprint is the set of digests of the chunks with their lengths, written as
text. Since cuts depend on the bytes around them only, an edit changes the chunks
it touches and cuts fall into place again behind it.

The likeness of two fingerprints is their containment by length: the bytes of
chunks in both over the bytes of the smaller set's chunks.

Defined results: a null text is empty; an empty text has the empty fingerprint,
like only another empty one; equal texts have equal fingerprints; rows that share
a doc_id follow one another by checksum of the text; rows without a doc_id come
last; the last document's next is the first; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .line import cells
from .text import batch

WINDOW = 32
LEAST, NORMAL, MOST = 16, 48, 256
STRICT, LOOSE = 7, 4
DIGITS = 12
_GEAR = np.random.default_rng(20240517).integers(0, 1 << 32, 256, dtype=np.uint32)
_PIECE = 1 << 20


def gear(data: np.ndarray) -> np.ndarray:
    """sum(gear[b[i-j]] << j) over the last 32 bytes of each position, by doubling."""
    h = _GEAR[data]
    step = 1
    while step < WINDOW:
        shifted = h[:-step] << np.uint32(step)
        h[step:] += shifted
        step *= 2
    return h


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text."""
    n, found = len(data), []
    loose, strict = [], []
    for lo in range(0, n, _PIECE):  # bounded memory for very long texts
        from_ = max(0, lo - WINDOW)
        h = gear(data[from_ : lo + _PIECE])[lo - from_ :]
        at = np.flatnonzero((h >> np.uint32(32 - LOOSE)) == 0)
        loose.append(at + lo + 1)
        strict.append((h[at] >> np.uint32(32 - STRICT)) == 0)
    at = np.concatenate(loose) if loose else np.zeros(0, np.int64)
    hard = np.concatenate(strict).tolist() if strict else []
    at = at.tolist()
    start, i, m = 0, 0, len(at)
    while start < n:
        first, normal, end = start + LEAST, start + NORMAL, min(start + MOST, n)
        while i < m and at[i] < first:
            i += 1
        while i < m and at[i] < normal and not hard[i]:
            i += 1
        if i < m and at[i] <= end:
            end = at[i]
        found.append(end)
        start = end
    return found


def chunks(text: bytes) -> dict[str, int]:
    """Digest and length of each distinct chunk."""
    out, start = {}, 0
    for end in cuts(np.frombuffer(text, np.uint8)):
        piece = text[start:end]
        out[xxhash.xxh3_64_hexdigest(piece)[:DIGITS]] = end - start
        start = end
    return out


def written(found: dict[str, int]) -> str:
    return " ".join(f"{k}:{n}" for k, n in sorted(found.items()))


def likeness(a: dict[str, int], b: dict[str, int]) -> float:
    """Bytes of common chunks over those of the smaller set."""
    if not a or not b:
        return float(not a and not b)
    small, large = (a, b) if sum(a.values()) <= sum(b.values()) else (b, a)
    return sum(n for k, n in small.items() if k in large) / sum(small.values())


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the next text's first, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


class Ranges:
    """Ranges of the order (doc_id falling, nulls last, then checksum): quantiles of the ids, each cut evenly."""

    def __init__(self, bounds: list[int], cuts_each: int, null_parts: int):
        self.bounds, self.each, self.null_parts = np.unique(np.array(bounds, np.int64)), cuts_each, null_parts

    def of(self, doc_id: np.ndarray, missing: np.ndarray, crc: np.ndarray) -> np.ndarray:
        top = len(self.bounds)
        if not top:
            return (crc * self.null_parts) >> 32
        at = np.searchsorted(self.bounds, doc_id, "right")
        low, high = self.bounds[np.maximum(at - 1, 0)].astype(float), self.bounds[np.minimum(at, top - 1)].astype(float)
        inner = np.clip((doc_id - low) / np.maximum(high - low, 1) * self.each, 0, self.each - 1).astype(np.int64)
        # A stretch that is open to one side is one range.
        inner = np.where((at == 0) | (at == top), 0, inner)
        rising = at * self.each + inner
        return np.where(missing, (top + 1) * self.each + ((crc * self.null_parts) >> 32), top * self.each + self.each - 1 - rising)


def _keys(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = rows.column("doc_id")
    return ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), rows.column("crc").to_numpy(zero_copy_only=False)


def ranges(keys: DataFrame) -> tuple[Ranges, dict[tuple[int | None, int], list[int]]]:
    """The ranges, and for the first row of each (doc_id, crc) the range before, round about."""
    known = keys.where("doc_id is not null")
    total, nulls, low, high = keys.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.min("doc_id"), F.max("doc_id")).first()
    steps = [i / 256 for i in range(1, 256)]
    middle = known.agg(F.percentile_approx("doc_id", steps, 10000)).first()[0] or []
    order = Ranges([] if low is None else [low, *middle, high], cells(total, 256 * 50_000), cells(nulls, 50_000))

    def place(batches):
        for rows in batches:
            doc_id, missing, crc = _keys(rows)
            yield pa.RecordBatch.from_arrays([pa.array(order.of(doc_id, missing, crc)), rows.column("doc_id"), rows.column("crc")], names=["range", "doc_id", "crc"])

    placed = keys.mapInArrow(place, "range bigint, doc_id bigint, crc bigint")
    rows = placed.groupBy("range").agg(F.min(F.struct(F.bitwise_not("doc_id"), "crc")).alias("f")).orderBy("range").collect()
    firsts: dict[tuple[int | None, int], list[int]] = {}
    for k, r in enumerate(rows):
        key = (None if r["f"][0] is None else ~r["f"][0], r["f"]["crc"])
        firsts.setdefault(key, []).append(rows[k - 1]["range"])
    return order, firsts


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compare(doc_id: int | None, text: str, own: dict[str, int], following: str, next_own: dict[str, int]) -> tuple:
    changed = edited(text, following).encode()
    new = chunks(changed)
    return doc_id, len(text), hashlib.sha256(changed).hexdigest(), written(own), written(new), likeness(own, new), likeness(own, next_own)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row.

    Every row moves once, compressed, to the range of its id; the first row of
    each range also goes to the end of the range before.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order, firsts = ranges(docs.select("doc_id", F.crc32("text").alias("crc")))
    schema = pa.schema([("range", pa.int64()), ("ghost", pa.bool_()), ("doc_id", pa.int64()), ("crc", pa.int64()), ("body", pa.binary())])

    def squeeze(batches):
        press = zstandard.ZstdCompressor(level=1)
        for rows in batches:
            doc_id, missing, crc = _keys(rows)
            where = order.of(doc_id, missing, crc).tolist()
            body = [press.compress(x.encode()) for x in rows.column("text").to_pylist()]
            out = [(r, False, i, c, b) for r, i, c, b in zip(where, rows.column("doc_id").to_pylist(), crc.tolist(), body, strict=True)]
            out += [(before, True, *x[2:]) for x in out for before in firsts.get((x[2], x[3]), ())]
            yield batch(schema, **dict(zip(schema.names, zip(*out, strict=True), strict=True))) if out else pa.RecordBatch.from_pylist([], schema)

    def compare(batches):
        open_, last = zstandard.ZstdDecompressor(), None
        for rows in batches:
            for lo in range(0, rows.num_rows, 512):
                out = []
                for x in rows.slice(lo, 512).to_pylist():
                    text = open_.decompress(x["body"]).decode()
                    own = chunks(text.encode())
                    if last and last[0] == x["range"]:
                        out.append(_compare(*last[1:], text, own))
                    last = None if x["ghost"] else (x["range"], x["doc_id"], text, own)
                if out:
                    yield batch(_RESULT, **dict(zip(_RESULT.names, zip(*out, strict=True), strict=True)))

    squeezed = docs.withColumn("crc", F.crc32("text")).mapInArrow(squeeze, "range bigint, ghost boolean, doc_id bigint, crc bigint, body binary")
    dealt = squeezed.repartition("range").sortWithinPartitions("range", "ghost", F.desc_nulls_last("doc_id"), "crc")
    return dealt.mapInArrow(compare, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
