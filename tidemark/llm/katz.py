"""Katz backoff language model.

Tokens are lower-case (A-Z) words and one end per text. Every word of the training
documents counts as itself, as a history and as a follower:

    p(w | h)  = d(c) c(h,w) / c(h)        if the pair was seen
              = backoff(h) p1(w)          if not
    p1(w)     = d(c) c(w) / N, and what the discounts leave for an unseen word

with Good-Turing discounts d of counts up to 5, and backoff(h) such that the
words sum to one after every history. A history whose followers are all
undiscounted gets one more in its denominator; where every word has followed,
the shares are scaled to one. Discounts that the counts of counts cannot give
(outside 0..1) are (r - 1/2)/r. If ``share`` is above 0, words below that share of
the training tokens are one class instead, inside which each has its own share.

Counts live in tables partitioned by hash, one row of arrays per part: words with
their denominators and backoffs as histories, and pairs. Words and pairs with at
least ``cache`` of all counts, of which there can be no more than 1/cache, are
broadcast and looked up in the scoring tasks; all others are asked for by hash: a
task asks once per n-gram for all its documents, the part answers with sums per
document. A pair of held-out text that was not seen is handed on to the parts of
its two words. Pairs whose second word is rare lie in its part, where its count is
at hand; all others by the hash of the pair, so no part gathers a hot n-gram.

Defined results: a null or empty text is its end alone; a null doc_id counts as
held out; rows that share a doc_id are scored one by one; without training
documents every probability is that of an unseen word; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .text import batch, binaries, crc_of_ids, hash_one, hashes, pair, stretches, utf8, words

CACHE = 2.0**-19
FOLDS = 10
MAX_DISCOUNTED = 5
BYTES_PER_PART = 20 << 20
CHUNK = 8 << 20
_HELD_KEYS = 1_500_000

#: Inverses of the factors of ``mix`` and ``pair``.
_UNMIX = [np.uint64(pow(x, -1, 1 << 64)) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
END, START, RARE = (np.uint64(hash_one(x)) for x in (b"\x00end", b"\x00start", b"\x00rare"))


def shrink(values: np.ndarray) -> bytes:
    """Unsigned integers in the fewest bytes that hold them all."""
    top = int(values.max()) if len(values) else 0
    width = max(1, (top.bit_length() + 7) // 8)
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def widen(data: bytes, dtype=np.uint64) -> np.ndarray:
    narrow = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    whole = np.zeros((len(narrow), 8), np.uint8)
    whole[:, : data[0]] = narrow
    return whole.reshape(-1).view("<u8").astype(dtype)


def shrink_sorted(keys: np.ndarray) -> bytes:
    return shrink(np.diff(keys, prepend=np.uint64(0)))


def widen_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(widen(data), dtype=np.uint64)


def tokens(rows: pa.RecordBatch) -> Iterator[tuple]:
    """(rows from, to, token hashes with ends, document of each, position of the first token of each)."""
    data, offsets = utf8(rows.column("text"))
    for lo, hi in stretches(offsets, CHUNK):
        word, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for a, b in stretches(offsets[lo : hi + 1]):
            text, starts, ends, bounds = words(data, offsets[lo + a : lo + b + 1])
            word.append(hashes(text, starts, ends))
            counts.append(np.diff(bounds))
        counts = np.concatenate(counts) + 1
        last = np.cumsum(counts)
        token = np.full(int(last[-1]), END, np.uint64)
        inside = np.ones(len(token), bool)
        inside[last - 1] = False
        token[inside] = np.concatenate(word)
        yield lo, hi, token, np.repeat(np.arange(hi - lo), counts), last - counts


def held_out(rows: pa.RecordBatch) -> np.ndarray:
    return crc_of_ids(rows.column("doc_id")) % FOLDS == 0


def whole(values: np.ndarray) -> bytes:
    """Numbers of which most are whole: as integers, or all as they are."""
    integers = values.astype(np.uint64)
    return shrink(integers) if (integers == values).all() else b"\x00" + values.astype("<f8").tobytes()


def numbers(data: bytes) -> np.ndarray:
    return widen(data, np.float64) if data[0] else np.frombuffer(data, "<f8", offset=1)


def first_of(keys: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The first hash of each pair from the hash of the pair and the second."""
    x = keys ^ (keys >> np.uint64(31)) ^ (keys >> np.uint64(62))
    x = x * _UNMIX[1]
    x = (x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))) * _UNMIX[0]
    return ((x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))) - second) * _UNMIX[2]


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of hashes, so that the sorted hashes of a part lie close together."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def split(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of the (sorted) keys of each part, in order."""
    part = part_of(keys, parts)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for k in range(parts):
        if edges[k + 1] > edges[k]:
            yield k, order[edges[k] : edges[k + 1]]


def count_table(docs: DataFrame, keys_of: Callable, parts: int) -> DataFrame:
    """(part, keys, counts, of_counts, total) over the training documents; ``keys_of(token, first)`` gives one key per token."""
    sent = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        keys, counts = held.pop() if held else (np.zeros(0, np.uint64), None)
        if len(keys):
            found = list(split(keys, parts))
            yield batch(sent, part=[k for k, _ in found], keys=binaries([shrink_sorted(keys[at]) for _, at in found]), counts=binaries([shrink(counts[at]) for _, at in found]))

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for rows in batches:
            learn = ~held_out(rows)
            for lo, hi, token, owner, first in tokens(rows):
                keys, counts = np.unique(keys_of(token, first)[learn[lo:hi][owner]], return_counts=True)
                if held:
                    keys, counts = merge([held.pop(), (keys, counts)])
                held.append((keys, counts))
                if len(keys) > _HELD_KEYS:
                    yield from flush(held)
        yield from flush(held)

    done = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("of_counts", pa.list_(pa.int64())), ("total", pa.int64()), ("distinct", pa.int64())])

    def gather(key, table):
        keys, counts = merge([(widen_sorted(a), widen(b, np.int64)) for a, b in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True)])
        small = np.bincount(counts[counts <= MAX_DISCOUNTED + 1], minlength=MAX_DISCOUNTED + 2)[1:]
        return pa.table({"part": [key[0].as_py()], "keys": [shrink_sorted(keys)], "counts": [shrink(counts)], "of_counts": [small.tolist()], "total": [int(counts.sum())], "distinct": [len(keys)]}, schema=done)

    packed = docs.mapInArrow(count, "part int, keys binary, counts binary")
    return materialize(packed.groupBy("part").applyInArrow(gather, "part int, keys binary, counts binary, of_counts array<bigint>, total bigint, distinct bigint"))


def merge(tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key."""
    keys, counts = np.concatenate([k for k, _ in tables]), np.concatenate([n for _, n in tables])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key is, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing=0) -> np.ndarray:
    """The value of each wanted key, ``missing`` where there is none."""
    at, there = places(keys, wanted)
    return np.where(there, values[at], missing) if len(keys) else np.full(len(wanted), missing)


def summary(table: DataFrame) -> tuple[int, int, list[int]]:
    """Total, number of distinct keys and counts of counts 1..6."""
    picked = [F.sum(F.col("of_counts")[r]).alias(f"n{r}") for r in range(MAX_DISCOUNTED + 1)]
    row = table.agg(F.sum("total"), F.sum("distinct"), *picked).first()
    return row[0] or 0, row[1] or 0, [x or 0 for x in row[2:]]


def frequent(table: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys with at least ``least`` counts, sorted; no more than the total over ``least``."""

    def run(batches):
        for rows in batches:
            for x in rows.select(["keys", "counts"]).to_pylist():
                keys, counts = counted(x)
                large = counts >= least
                yield pa.RecordBatch.from_arrays([pa.array(keys[large].view(np.int64)), pa.array(counts[large])], names=["key", "count"])

    found = table.mapInArrow(run, "key bigint, count bigint").toArrow()
    keys, counts = found.column("key").to_numpy().view(np.uint64), found.column("count").to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def counted(x: dict) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a row of a table, or of one sent along with questions."""
    return widen_sorted(x["keys"]), widen(x["counts"] if "counts" in x else x["many"], np.int64)


def discounts(of_counts: list[int]) -> np.ndarray:
    """d(0..5) from the counts of counts 1..6; counts above 5 are kept whole."""
    r = np.arange(1, MAX_DISCOUNTED + 1)
    d = np.concatenate([[1.0], (r - 0.5) / r])
    n = np.array(of_counts, float)
    if n[0]:
        common = (MAX_DISCOUNTED + 1) * n[MAX_DISCOUNTED] / n[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            turing = ((r + 1) * n[1:] / (r * n[:-1]) - common) / (1 - common)
        good = (turing > 0) & (turing < 1)
        d[1:][good] = turing[good]
    return d


def weights(totals: np.ndarray, kept: np.ndarray, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Denominators and backoffs of histories from their counts, discounted counts, and the p1 of what followed them."""
    denominator = np.where(totals > 0, np.where(kept >= totals, totals + 1, totals), 1.0)
    left, free = 1 - kept / denominator, 1 - covered
    every = (totals > 0) & (free < 1e-9)
    denominator = np.where(every, np.maximum(kept, 1e-300), denominator)
    return denominator, np.where(totals > 0, np.where(every, 0.0, left / np.maximum(free, 1e-300)), 1.0)


def log10(values: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(values, 1e-300))


class Model:
    """What tasks hold: the discounts, the frequent words with their numbers, and the frequent pairs.

    With ``classes``, all other words are one class, a word of its own here.
    """

    def __init__(self, total: int, distinct: int, of_counts: list[int], keys: np.ndarray, counts: np.ndarray, classes: bool):
        self.total, self.distinct, self.classes = total, distinct, classes
        self.d1 = discounts(of_counts)
        r = np.arange(1, MAX_DISCOUNTED + 1)
        lost = float((np.array(of_counts[:-1]) * r * (1 - self.d1[1:])).sum())
        self.whole = total if lost > 0 else total + 1
        self.unseen = 1 - (total - lost) / self.whole if total else 1.0
        own = [END, START, *([RARE] if classes else [])]
        self.words = np.unique(np.concatenate([keys, np.array(own, np.uint64)]))
        self.counts = look_up(keys, counts, self.words)
        self.p1 = self.seen(self.counts)
        self.p1[self.words == START] = 0.0
        if classes:
            rare = self.words == RARE
            self.p1[rare] = max(0.0, 1 - self.p1[~rare].sum())
            self.p1_rare = float(self.p1[rare][0])

    def seen(self, counts: np.ndarray) -> np.ndarray:
        """p1 of words with these counts; of an unseen word where 0."""
        kept = counts * self.d1[np.where(counts <= MAX_DISCOUNTED, counts, 0)]
        return np.where(counts > 0, kept / self.whole, self.unseen) if self.total else np.ones(len(counts))

    def kept(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts of pairs."""
        return counts * self.d2[np.where(counts <= MAX_DISCOUNTED, counts, 0)]

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.total + 0.1 * (self.distinct + 1)))

    def within_rare(self, counts: np.ndarray) -> np.ndarray:
        return np.log10(self.seen(counts) / self.p1_rare) if self.p1_rare > 0 else np.zeros(len(counts))

    def find(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the tokens among the frequent words, and which of them are there."""
        return places(self.words, token)

    def pairs(self, token: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """History and word of each token, each its class where there are classes."""
        word = np.where(self.find(token)[1], token, RARE) if self.classes else token
        history = np.empty_like(word)
        history[1:] = word[:-1]
        history[first] = START
        return history, word

    def shifted(self, at: np.ndarray, known: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the histories of tokens found ``at``, and which of them are there."""
        if self.classes:
            at, known = np.where(known, at, self.find(RARE)[0]), np.ones_like(known)
        before, there = np.empty_like(at), np.empty_like(known)
        before[1:], there[1:] = at[:-1], known[:-1]
        before[first], there[first] = self.find(START)[0], True
        return before, there

    def part(self, keys: np.ndarray, word: np.ndarray) -> np.ndarray:
        """What pairs are dealt by: a rare word, or the pair."""
        return np.where(self.find(word)[1], keys, word)

    def pack(self, token: np.ndarray) -> bytes:
        at, known = self.find(token)
        numbers = shrink(at[known])
        return b"".join([len(token).to_bytes(8, "little"), len(numbers).to_bytes(8, "little"), np.packbits(known).tobytes(), numbers, token[~known].astype("<u8").tobytes()])

    def unpack(self, data: bytes) -> np.ndarray:
        n, size, end = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little"), 16 + (int.from_bytes(data[:8], "little") + 7) // 8
        known = np.unpackbits(np.frombuffer(data[16:end], np.uint8), count=n).astype(bool)
        token = np.empty(n, np.uint64)
        token[known] = self.words[widen(data[end : end + size], np.int64)]
        token[~known] = np.frombuffer(data[end + size :], "<u8")
        return token


def pair_table(docs: DataFrame, single: DataFrame, sent, parts: int) -> DataFrame:
    """(part, keys, after, counts, after_counts, of_counts, total, distinct): the pairs of the training documents, sorted by hash, and the counts of rare second words."""
    schema = pa.schema([("part", pa.int32()), *((x, pa.binary()) for x in ("before", "after", "counts"))])

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        if held and len(held[0][0]):
            m, (keys, history, word, counts) = sent.value, held.pop()
            found = list(split(m.part(keys, word), parts))
            yield batch(schema, part=[k for k, _ in found], before=binaries([m.pack(history[at]) for _, at in found]), after=binaries([m.pack(word[at]) for _, at in found]), counts=binaries([shrink(counts[at]) for _, at in found]))

    def count(batches):
        m, held = sent.value, []
        for rows in batches:
            learn = ~held_out(rows)
            for lo, hi, token, owner, first in tokens(rows):
                picked = learn[lo:hi][owner]
                history, word = (x[picked] for x in m.pairs(token, first))
                earlier = [x[1:] for x in held]
                held[:] = [merge_pairs([*earlier, (history, word, np.ones(len(word), np.int64))])]
                if len(held[0][0]) > _HELD_KEYS:
                    yield from flush(held)
        yield from flush(held)

    done = pa.schema([("part", pa.int32()), *((x, pa.binary()) for x in ("keys", "after", "counts", "after_counts")), ("of_counts", pa.list_(pa.int64())), ("total", pa.int64()), ("distinct", pa.int64())])

    def gather(key, table):
        m, rows = sent.value, table.to_pylist()
        found = [(m.unpack(x["before"]), m.unpack(x["after"]), widen(x["counts"], np.int64)) for x in rows if x["keys"] is None]
        if not found:
            return pa.table({x: [] for x in done.names}, schema=done)
        keys, history, word, counts = merge_pairs(found)
        rare = ~m.find(word)[1]
        follows = look_up(*next((counted(x) for x in rows if x["keys"] is not None), (np.zeros(0, np.uint64), np.zeros(0, np.int64))), word[rare])
        small = np.bincount(counts[counts <= MAX_DISCOUNTED + 1], minlength=MAX_DISCOUNTED + 2)[1:]
        return pa.table({"part": [key[0].as_py()], "keys": [shrink_sorted(keys)], "after": [m.pack(word)], "counts": [shrink(counts)], "after_counts": [shrink(follows)], "of_counts": [small.tolist()], "total": [int(counts.sum())], "distinct": [len(keys)]}, schema=done)

    none = F.lit(None).cast("binary")
    packed = docs.mapInArrow(count, "part int, before binary, after binary, counts binary").withColumn("keys", none)
    beside = single.select("part", none.alias("before"), none.alias("after"), "counts", "keys")
    return materialize(packed.union(beside).groupBy("part").applyInArrow(gather, "part int, keys binary, after binary, counts binary, after_counts binary, of_counts array<bigint>, total bigint, distinct bigint"))


def merge_pairs(tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, histories, words and sums of counts by pair, sorted by hash."""
    history, word, counts = (np.concatenate([x[i] for x in tables]) for i in range(3))
    keys = pair(history, word)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    at = order[new]
    return keys[new], history[at], word[at], np.add.reduceat(counts[order], new) if len(new) else counts


def fit(docs: DataFrame, share: float = 0.0, cache: float = CACHE) -> tuple[Model, DataFrame, DataFrame, int]:
    """The model, its tables of words (part, keys, counts, denominator, backoff) and of pairs, and their number of parts."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // BYTES_PER_PART))
    single = count_table(docs, lambda token, first: token, parts)
    total, distinct, of_counts = summary(single)
    keys, counts = frequent(single, max(1, total * (share or cache)))
    if END not in keys:  # too rare to be found above, but always there
        ends = single.mapInArrow(count_of(END), "n bigint").agg(F.sum("n")).first()[0] or 0
        at = np.searchsorted(keys, END)
        keys, counts = np.insert(keys, at, END), np.insert(counts, at, ends)
    model = Model(total, distinct, of_counts, keys, counts, share > 0)
    sent = spark.sparkContext.broadcast(model)
    double = pair_table(docs, single, sent, parts)
    pair_total, _, of_pairs = summary(double)
    model.d2 = d2 = discounts(of_pairs)

    def sums(x: dict) -> tuple:
        """Histories of a row of pairs, and the counts, discounted counts and p1 of what followed each."""
        m, (keys, counts) = sent.value, counted(x)
        word = m.unpack(x["after"])
        history = first_of(keys, word)
        at, known = m.find(word)
        p1 = np.empty(len(word))
        p1[known], p1[~known] = m.p1[at[known]], m.seen(widen(x["after_counts"], np.int64))
        found, h = np.unique(history, return_inverse=True)
        kept = counts * d2[np.where(counts <= MAX_DISCOUNTED, counts, 0)]
        return found, *(np.bincount(h, v, len(found)).astype(float) for v in (counts, kept, p1))

    def of_frequent(batches):
        for rows in batches:
            for x in rows.to_pylist():
                found, *values = sums(x)
                at, known = sent.value.find(found)
                yield pa.RecordBatch.from_arrays([pa.array(at[known]), *(pa.array(v[known]) for v in values)], names=["h", "t", "k", "c"])

    rare = pa.schema([("part", pa.int32()), *((x, pa.binary()) for x in ("keys", "counts", "k", "c"))])

    def of_rare(batches):
        for rows in batches:
            for x in rows.to_pylist():
                found, t, k, c = sums(x)
                other = ~sent.value.find(found)[1]
                found, t, k, c = found[other], t[other].astype(np.int64), k[other], c[other]
                deal = list(split(found, parts))
                yield batch(rare, part=[p for p, _ in deal], keys=binaries([shrink_sorted(found[at]) for _, at in deal]), counts=binaries([shrink(t[at]) for _, at in deal]), k=binaries([k[at].tobytes() for _, at in deal]), c=binaries([c[at].tobytes() for _, at in deal]))

    done = pa.schema([("part", pa.int32()), *((x, pa.binary()) for x in ("keys", "counts", "denominator", "backoff"))])

    def beside(key, table):
        rows = table.to_pylist()
        keys, counts = next(counted(x) for x in rows if x["k"] is None)
        t, k, c = (np.zeros(len(keys)) for _ in range(3))
        for x in rows:
            if x["k"] is not None:
                at = places(keys, widen_sorted(x["keys"]))[0]
                for into, values in ((t, widen(x["counts"], float)), (k, np.frombuffer(x["k"])), (c, np.frombuffer(x["c"]))):
                    into[at] += values
        denominator, backoff = weights(t, k, c)
        return pa.table({"part": [key[0].as_py()], "keys": [shrink_sorted(keys)], "counts": [shrink(counts)], "denominator": [whole(denominator)], "backoff": [backoff.tobytes()]}, schema=done)

    found = double.mapInArrow(of_frequent, "h bigint, t double, k double, c double").groupBy("h").agg(*[F.sum(x).alias(x) for x in "tkc"]).toArrow()
    h = found.column("h").to_numpy()
    model.denominator, model.backoff = weights(*(np.bincount(h, found.column(x).to_numpy(), len(model.words)) for x in "tkc"))
    none = F.lit(None).cast("binary")
    both = single.select("part", "keys", "counts", none.alias("k"), none.alias("c")).union(double.mapInArrow(of_rare, "part int, keys binary, counts binary, k binary, c binary"))
    table = materialize(both.groupBy("part").applyInArrow(beside, "part int, keys binary, counts binary, denominator binary, backoff binary"))
    model.pair_keys, model.pair_counts = frequent(double, max(2, pair_total * (share or cache)))
    return model, table, double, parts


def count_of(key: np.uint64) -> Callable:
    def run(batches):
        for rows in batches:
            for x in rows.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(look_up(*counted(x), np.array([key])))], names=["n"])

    return run


PAIR, WORD, META, FIRST, BACK = 0, 1, 2, 3, 4
_SENT = "part int, kind int, chunk bigint, keys binary, many binary, docs binary, times binary, before binary, after binary"
_ASKED = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), *[(x, pa.binary()) for x in ("keys", "many", "docs", "times", "before", "after")]])
_ANSWERED = pa.schema([*_ASKED, *[(x, pa.binary()) for x in ("score", "base", "known")]])


def _asked(keys: np.ndarray, owner: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys and where each is first, documents per key, and the documents and occurrences of each key in turn."""
    distinct, first, at = np.unique(keys, return_index=True, return_inverse=True)
    both, times = np.unique(at.astype(np.uint64) * np.uint64(docs) + owner.astype(np.uint64), return_counts=True)
    return distinct, first, np.bincount((both // np.uint64(docs)).astype(np.int64), minlength=len(distinct)), both % np.uint64(docs), times


def score(docs: DataFrame, share: float = 0.0, cache: float = CACHE) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model, single, double, parts = fit(docs, share, cache)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def ask(batches):
        from pyspark import TaskContext

        m, chunk = sent.value, TaskContext.get().partitionId() << 32
        for rows in batches:
            held = held_out(rows)
            doc_ids = rows.column("doc_id")
            for lo, hi, token, owner, first in tokens(rows):
                n, (history, word) = hi - lo, m.pairs(token, first)
                keys = pair(history, word)
                common = look_up(m.pair_keys, m.pair_counts, keys)
                near = common > 0
                at, own = m.find(token)
                before, there = m.shifted(at, own, first)
                value = np.bincount(owner[near], np.log10(m.kept(common[near])), n) - np.bincount(owner[there], np.log10(m.denominator[before[there]]), n)
                base = np.bincount(owner[own], m.base(m.counts[at[own]]), n)
                known = np.bincount(owner[own], m.counts[at[own]] > 0, n).astype(np.int64)
                ends = np.append(first[1:], len(token)) - first
                given = pa.RecordBatch.from_arrays([doc_ids.slice(lo, n), pa.array(held[lo:hi]), pa.array(ends), pa.array(known), pa.array(base), pa.array(value)], names=["doc_id", "held_out", "n_tokens", "known", "base", "score"])
                out = [(chunk % parts, META, chunk, _bytes(given), b"", b"", b"", b"", b"")]
                new = held[lo:hi][owner]
                # What was learnt from is there; of other pairs the words are sent along.
                for kind, picked, whole in ((PAIR, ~near & ~new, False), (PAIR, ~near & new, True), (WORD, ~own, False)):
                    distinct, at_, many, who, times = _asked((token if kind == WORD else keys)[picked], owner[picked], n)
                    of = history[picked][at_], word[picked][at_]
                    ends_ = np.cumsum(many)
                    for part, at_ in split(distinct if kind == WORD else m.part(distinct, of[1]), parts):
                        posts = _ranges(ends_[at_] - many[at_], many[at_])
                        out.append((part, kind, chunk, shrink_sorted(distinct[at_]), shrink(many[at_]), shrink(who[posts]), shrink(times[posts]), *((m.pack(x[at_]) if whole else b"") for x in of)))
                yield batch(_ASKED, **dict(zip(_ASKED.names, zip(*out, strict=True), strict=True)))
                chunk += 1

    def sums(x: dict, *values: np.ndarray) -> tuple[bytes, ...]:
        """The documents of a question, and the sums of the values of its keys for each."""
        many, who, times = widen(x["many"], np.int64), widen(x["docs"], np.int64), widen(x["times"], np.float64)
        docs_, at = np.unique(who, return_inverse=True)
        return shrink(docs_), *(np.bincount(at, np.repeat(v, many) * times, len(docs_)).tobytes() for v in values)

    def forward(x: dict, kind: int, keys: np.ndarray, at: np.ndarray) -> Iterator[tuple]:
        """The question ``x`` about the words ``keys``, at the places ``at`` of its own keys."""
        many, who, times = widen(x["many"], np.int64), widen(x["docs"], np.int64), widen(x["times"], np.int64)
        order = np.argsort(keys, kind="stable")
        keys, at, starts = keys[order], at[order], np.cumsum(many) - many
        for part, own in split(keys, parts):
            posts = _ranges(starts[at[own]], many[at[own]])
            yield part, kind, x["chunk"], shrink_sorted(keys[own]), shrink(many[at[own]]), shrink(who[posts]), shrink(times[posts]), b"", b"", b"", b"", b""

    def answered(out: list[tuple]) -> pa.Table:
        return pa.table(dict(zip(_ANSWERED.names, map(list, zip(*out, strict=True)), strict=True)) if out else {x: [] for x in _ANSWERED.names}, schema=_ANSWERED)

    def final(x: dict, docs_: bytes, score: bytes, base: bytes = b"", known: bytes = b"") -> tuple:
        return x["part"], x["kind"], x["chunk"], b"", b"", docs_, b"", b"", b"", score, base, known

    def answer_pairs(m: Model, rows: list[dict]) -> Iterator[tuple]:
        stored = [x for x in rows if x["chunk"] < 0]
        have, have_counts = counted(stored[0]) if stored else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for x in rows:
            if x["chunk"] < 0:
                continue
            counts = look_up(have, have_counts, widen_sorted(x["keys"]))
            value, lost = log10(m.kept(counts)), np.flatnonzero(counts == 0)
            if len(lost):
                history, word = m.unpack(x["before"])[lost], m.unpack(x["after"])[lost]
                (h, h_own), (w, w_own) = m.find(history), m.find(word)
                value[lost] = np.where(h_own, log10(m.denominator[h]) + log10(m.backoff[h]), 0) + np.where(w_own, log10(m.p1[w]), 0)
                yield from forward(x, BACK, history[~h_own], lost[~h_own])
                yield from forward(x, FIRST, word[~w_own], lost[~w_own])
            yield final(x, *sums(x, value))

    def answer_words(m: Model, rows: list[dict]) -> Iterator[tuple]:
        stored = [x for x in rows if x["chunk"] < 0]
        have, have_counts = counted(stored[0]) if stored else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        denominator = log10(numbers(stored[0]["before"])) if stored else np.zeros(0)
        backoff = log10(np.frombuffer(stored[0]["after"])) if stored and stored[0]["after"] else 0.0
        for x in rows:
            if x["chunk"] < 0:
                continue
            asked = widen_sorted(x["keys"])
            counts = look_up(have, have_counts, asked)
            if x["kind"] == WORD:
                value = m.within_rare(counts) if m.classes else -look_up(have, denominator, asked, 0.0)
                yield final(x, *sums(x, value, m.base(counts), (counts > 0).astype(float)))
            else:
                yield final(x, *sums(x, log10(m.seen(counts)) if x["kind"] == FIRST else look_up(have, denominator + backoff, asked, 0.0)))

    def answer(key, table):
        m, kind, rows = sent.value, key[1].as_py(), table.to_pylist()
        if kind == META:
            return answered([(x["part"], META, x["chunk"], b"", b"", b"", b"", b"", b"", x["keys"], b"", b"") for x in rows])
        return answered(list(answer_pairs(m, rows) if kind == PAIR else answer_words(m, rows)))

    def answer_forwarded(key, table):
        return answered(list(answer_words(sent.value, table.to_pylist())))

    result = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def add_up(key, table):
        rows = table.to_pylist()
        given = _table(next(x["score"] for x in rows if x["kind"] == META))
        value, base, known = (given.column(x).to_numpy().astype(float) for x in ("score", "base", "known"))
        for x in rows:
            if x["kind"] != META:
                at = widen(x["docs"], np.int64)
                value[at] += np.frombuffer(x["score"])
                if x["kind"] == WORD:
                    base[at] += np.frombuffer(x["base"])
                    known[at] += np.frombuffer(x["known"])
        n = given.column("n_tokens")
        return pa.table([given.column("doc_id"), given.column("held_out"), n, np.rint(known).astype(np.int64), np.full(len(n), sent.value.total), base, value], schema=result)

    asked = docs.mapInArrow(ask, _SENT)
    nothing = F.lit(b"")

    def stored(table, kind, before, after):
        return table.select("part", F.lit(kind).alias("kind"), F.lit(-1).cast("bigint").alias("chunk"), "keys", F.col("counts").alias("many"), nothing.alias("docs"), nothing.alias("times"), before.alias("before"), after.alias("after"))

    sums_ = _SENT + ", score binary, base binary, known binary"
    answers = materialize(asked.union(stored(double, PAIR, nothing, nothing)).union(stored(single, WORD, F.col("denominator"), nothing)).groupBy("part", "kind").applyInArrow(answer, sums_))
    forwarded = answers.where(F.col("kind").isin(FIRST, BACK))
    if not forwarded.isEmpty():
        last = forwarded.select(*asked.columns).union(stored(single, WORD, F.col("denominator"), F.col("backoff"))).groupBy("part").applyInArrow(answer_forwarded, sums_)
        answers = answers.where(~F.col("kind").isin(FIRST, BACK)).union(last)
    return answers.groupBy("chunk").applyInArrow(add_up, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of several ranges in a row."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def _bytes(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()
