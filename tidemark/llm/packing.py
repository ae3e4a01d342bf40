"""Best-fit packing with certified bounds.

Documents become token ids, longer ones pieces of at most ``capacity`` tokens.
Each partition packs its pieces by best-fit decreasing. Lower bounds from dual
feasible functions tell which partitions use as few sequences as any packing
can. Partitions with a gap give up every sequence with room left, certified ones
only their emptiest, and what was given up is dealt anew over fewer partitions
and packed again, until the bound over the whole table is met or a round gains
nothing; so the number of sequences never rises.

Defined results: a null text is empty; a document without tokens still has its
end id; rows that share a doc_id are packed one by one; an empty table gives no
rows. Columns other than doc_id and text play no part.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from struct import pack as packed

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .text import batch, memo

CAPACITY = 4096
END_ID = 1
PIECES_PER_PARTITION = 100_000
#: Bytes of words and ids in a generation of a worker's memo, each counted with what keeping it takes.
_MEMO_BYTES, _ENTRY_BYTES = 100 << 20, 200
#: Words handed to the tokenizer at once: what it returns takes a few KB each.
_ENCODED = 2048

PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_PARTS = re.compile(rb"[A-Za-z]+|[0-9]|[^A-Za-z0-9]+")
_MARKS = re.compile(rb"[\xcc\xcd]")


class WordIds:
    """Ids of texts, word by word, as little-endian 32-bit strings.

    The tokenizer drops white space and never joins across it, so the ids of a
    text are those of its words in a row. The ids of a word are kept; a word of
    ASCII letters, digits and symbols (no apostrophe, no special token) splits
    further into runs that the tokenizer treats alone. When the words kept
    exceed their bytes they become the older generation: of it, those met again
    move to the new one, and the rest go when that is full as well.
    """

    def __init__(self, path: str, memo_bytes: int | None = None):
        from tokenizers import Tokenizer

        self.memo_bytes = memo_bytes or _MEMO_BYTES
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0

    def keep(self, items: dict[bytes, bytes]) -> None:
        self.known.update(items)
        self.held += sum(map(len, items)) + sum(map(len, items.values())) + _ENTRY_BYTES * len(items)

    def encode(self, items: list[bytes]) -> None:
        for lo in range(0, len(items), _ENCODED):
            part = items[lo : lo + _ENCODED]
            found = self.tokenizer.encode_batch_fast([x.decode() for x in part], add_special_tokens=False)
            self.keep({x: packed(f"<{len(ids)}I", *ids) for x, ids in zip(part, (y.ids for y in found), strict=True)})

    def learn(self, items: set[bytes]) -> None:
        split, ended, direct = {}, [], set()
        for x in items:
            if not x.isascii() or x.isalpha():
                direct.add(x)
            elif x[:-1].isalpha() and x[-1:] in b".,":
                ended.append(x)
                direct.add(x[:-1])
            elif b"'" not in x and b"<|" not in x:
                split[x] = _PARTS.findall(x)
                direct.update(split[x])
            else:
                direct.add(x)
        known = self.known
        direct = direct.union((b".", b",")).difference(known)
        self.keep(again := {x: self.older[x] for x in direct if x in self.older})
        self.encode([x for x in direct if x not in again])
        stops = {x: known[x] for x in (b".", b",")}
        self.keep({x: known[x[:-1]] + stops[x[-1:]] for x in ended})
        self.keep({x: b"".join([known[p] for p in parts]) for x, parts in split.items()})

    def of(self, texts: list[bytes]) -> Iterator[bytes]:
        split = [plain(x).split(b" ") for x in texts]
        if self.held > self.memo_bytes:
            self.known, self.older, self.held = {}, self.known, 0
        new = set().union(*split).difference(self.known) if split else set()
        if self.older:
            self.keep(again := {x: self.older[x] for x in new if x in self.older})
            new.difference_update(again)
        if new:
            self.learn(new)
        get = self.known.__getitem__
        for x in split:
            yield b"".join(map(get, x))


def plain(text: bytes) -> bytes:
    """A text with the same ids and fewer distinct words.

    A-Z become small, except in texts with special tokens, which are told by
    case, or with combining marks, which join capitals differently.
    """
    if b"<|" not in text and not _MARKS.search(text):
        text = text.lower()
    return text.replace(b"\n", b" ")


def encoder(path: str, memo_bytes: int | None = None) -> WordIds:
    """One per Python worker, which serves many tasks."""
    encoders = memo("packing")
    if path not in encoders:
        encoders[path] = WordIds(path)
    encoders[path].memo_bytes = memo_bytes or _MEMO_BYTES
    return encoders[path]


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, memo_bytes: int | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of every document.

    A worker keeps the ids of words in two generations of about ``memo_bytes`` (100 MiB); fewer bytes only cost time.
    """
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids_of = encoder(tokenizer, memo_bytes)
        for rows in batches:
            for lo in range(0, rows.num_rows, 500):
                part = rows.slice(lo, 500)
                keys = part.column("doc_id").to_pylist()
                out = []
                for key, ids in zip(keys, ids_of.of([x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()]), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        out.append((key, k, at // 4, len(cut) // 4, zlib.crc32(cut)))
                yield batch(schema, **dict(zip(schema.names, zip(*out, strict=True), strict=True)))

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, PIECE_SCHEMA)


def bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: the best of two families of dual feasible functions.

    The first drops small lengths and rounds large ones up to the capacity, for
    each threshold; the second rounds to multiples of capacity/k.
    """
    if not len(lengths):
        return 0
    order = np.argsort(lengths)
    x, n = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    best = -(-int((x * n).sum()) // capacity)
    total, number = np.concatenate([[0], np.cumsum(x * n)]), np.concatenate([[0], np.cumsum(n)])
    small = np.concatenate([[0], x[x <= capacity // 2]])
    low, high = np.searchsorted(x, small, "left"), np.searchsorted(x, capacity - small, "right")
    need = capacity * (number[-1] - number[high]) + total[high] - total[low]
    best = max(best, int((-(-need // capacity)).max()))
    for k in range(1, 65):  # in units of 1/k, exactly
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, k * x, scaled // capacity * capacity)
        best = max(best, int(-(-int((value * n).sum()) // (k * capacity))))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each item, taken in the given (decreasing) order, and the room left in each bin.

    Open bins are stacked by their room; the bits of one integer tell which
    stacks are not empty, so the tightest fit is its lowest bit from the length on.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, room, filled = [], [], [], 0
    for need in lengths.tolist():
        fits = filled >> need
        if fits:
            left = need + (fits & -fits).bit_length() - 1
            at = stacks[left].pop()
            if not stacks[left]:
                filled ^= 1 << left
        else:
            at, left = len(room), capacity
            room.append(capacity)
        bins.append(at)
        offsets.append(capacity - left)
        room[at] = left = left - need
        if left:
            stacks[left].append(at)
            filled |= 1 << left
    return np.array(bins, np.int64), np.array(offsets, np.int64), room


def _pack_partitions(pieces: DataFrame, parts: int, turn: int, capacity: int) -> DataFrame:
    """Adds sequence_id, offset, room (of the sequence), and its partition's number of sequences and bound."""
    columns = pieces.columns
    schema = pieces.select(*columns).schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")

    def run(frames):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        frames = [x for x in frames if len(x)]
        if not frames:
            return
        rows = pd.concat(frames)
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        lengths = rows["length"].to_numpy(np.int64)
        bins, offsets, room = best_fit(lengths, capacity)
        sizes, counts = np.unique(lengths, return_counts=True)
        rows["sequence_id"] = (turn << 52) + (part << 28) + bins
        rows["offset"], rows["room"] = offsets, np.array(room, np.int64)[bins]
        rows["turn"], rows["part"], rows["bins"], rows["least"] = turn, part, len(room), bound(sizes, counts, capacity)
        yield rows

    dealt = pieces.repartition(parts, F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(turn)))
    return dealt.mapInPandas(run, f"{schema}, sequence_id bigint, offset bigint, room bigint, turn int, part int, bins bigint, least bigint")


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_partition: int = PIECES_PER_PARTITION, rounds: int = 8) -> DataFrame:
    """``pieces`` with the sequence and the offset of each.

    What reaches the driver: one count per length (at most ``capacity``) and the
    totals of each round.
    """
    columns = pieces.columns
    sizes = pieces.groupBy("length").count().toPandas()
    if not len(sizes):
        return pieces.select(*columns, F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    least = bound(sizes["length"].to_numpy(np.int64), sizes["count"].to_numpy(np.int64), capacity)
    rows = int(sizes["count"].sum())
    packed = materialize(_pack_partitions(pieces, -(-rows // per_partition), 0, capacity))
    used = packed.select("part", "bins").distinct().agg(F.sum("bins")).first()[0]
    for turn in range(1, rounds + 1):
        if used <= least:
            break
        emptiest = packed.groupBy("turn", "part").agg(F.max(F.struct("room", "sequence_id")).alias("e"))
        opened = packed.where((F.col("bins") > F.col("least")) & (F.col("room") > 0)).select("sequence_id")
        opened = materialize(opened.union(emptiest.where("e.room > 0").select("e.sequence_id")).distinct())
        given = packed.join(opened, "sequence_id", "left_semi").select(*columns)
        kept = packed.join(opened, "sequence_id", "left_anti")
        before, amount = opened.count(), given.count()
        again = materialize(_pack_partitions(given, -(-amount // per_partition), turn, capacity))
        after = again.select("part", "bins").distinct().agg(F.sum("bins")).first()[0] or 0
        if after >= before:
            break
        packed, used = kept.unionByName(again), used - before + after
    return packed.select(*columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, memo_bytes: int | None = None) -> DataFrame:
    return pack(materialize(tokenize(docs, tokenizer, capacity, end_id, memo_bytes)), capacity)
