"""Repeated passages by collinear chaining.

Seeds are k-mers of lower-case (A-Z) words, chosen by winnowing: every run of
``KMER + WINDOW - 1`` words chooses at least one, the same one in every text.
Each seed joins its first holder (smallest doc_id) with all others, so a seed in
m documents gives m - 1 matches. The matches of a pair of documents are chained:
a Fenwick tree over positions in the first document finds, for each match in
turn, the best chain before it under a cost for the words skipped on both sides.
Chains are cut at gaps of over ``GAP`` words, then aligned on the words of both
texts: along diagonals, by common subsequence between them, and outwards from
both ends until mismatches outweigh. A passage is an alignment of at least
``WORDS`` words of which ``IDENTITY`` agree; one that only its outer parts spoil
is taken without them.

The first holder of a seed need not have the passage around it. So the words of
each document that no passage covers take part again: every run of ``WORDS`` of
them joins its own first holder, which has all of it. Only runs whose seeds all
stand in smaller documents too can have one. Every exact copy of ``WORDS`` words of
a smaller doc_id is thus covered. Of a fuzzy passage each seed may stand elsewhere
first; so the seeds that no passage covers take part once more, two by two: all
that a chain may link, up to ``GAP`` words apart, join the first holder of both. A
fuzzy passage is found if enough of its seeds, or of its pairs of seeds, have one
first holder.

Defined results: texts without enough words have no seeds; rows with a null
doc_id take no part; of rows that share a doc_id, the one whose text has the
least checksum stands for the id; repeats inside one text do not count; of equal
passages the one in the smallest doc_id is the original. An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..joins import BROADCAST_BYTES, bounded_broadcast
from ..session import materialize
from .text import batch, binaries, hashes, memo, owners, pair, stretches, utf8, words

KMER, WINDOW = 6, 16
WORDS, IDENTITY = 50, 0.8
GAP, GAP_COST = 40, 0.05
MARGIN = 40
REQUESTS_PER_ROW = 256


def _slide(values: np.ndarray, width: int, take) -> np.ndarray:
    """``take`` (minimum or maximum) over ``width`` values from each on, by doubling; the end is shorter."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = take(out[:-step], out[step:])
        have += step
    return out


def seeds(word: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the chosen k-mers of a stretch of documents."""
    if len(word) < KMER:
        return word[:0], np.zeros(0, np.int64)
    kmer = word.copy()
    for j in range(1, KMER):
        kmer[: len(word) - j] = pair(kmer[: len(word) - j], word[j:])
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for j in range(1, KMER):  # k-mers across the end of a document
        at = bounds[1:] - j
        kmer[at[at >= 0]] = top
    least = _slide(kmer, WINDOW, np.minimum)
    best = _slide(least[::-1].copy(), WINDOW, np.maximum)[::-1]
    chosen = np.flatnonzero((best == kmer) & (kmer != top))
    return kmer[chosen], chosen


def word_runs(word: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words from each word on that has so many after it, by doubling."""
    n = len(word) - width + 1
    if n <= 0:
        return word[:0]
    out, power, at, size = np.zeros(n, np.uint64), word, 0, 1
    while size <= width:
        if width & size:
            out = pair(out, power[at : at + n])
            at += size
        power, size = pair(power[:-size], power[size:]), 2 * size
    return out


def find_seeds(docs: DataFrame) -> DataFrame:
    """(seed, doc, pos) of every document."""
    schema = pa.schema([("seed", pa.int64()), ("doc", pa.int64()), ("pos", pa.int32())])

    def run(batches):
        memo("chaining")
        for rows in batches:
            data, offsets = utf8(rows.column("text"))
            ids = rows.column("doc_id").to_numpy()
            for lo, hi in stretches(offsets):
                text, starts, ends, bounds = words(data, offsets[lo : hi + 1])
                seed, at = seeds(hashes(text, starts, ends), bounds)
                whose = owners(bounds)[at]
                yield batch(schema, seed=seed.view(np.int64), doc=ids[lo:hi][whose], pos=(at - bounds[whose]).astype(np.int32))

    return docs.mapInArrow(run, "seed bigint, doc bigint, pos int")


class Fenwick:
    """Prefix maxima with the index that holds them."""

    def __init__(self, size: int):
        self.size, self.best, self.at = size, [-1e300] * (size + 1), [-1] * (size + 1)

    def put(self, i: int, value: float, index: int) -> None:
        i += 1
        while i <= self.size:
            if value > self.best[i]:
                self.best[i], self.at[i] = value, index
            i += i & -i

    def before(self, i: int) -> tuple[float, int]:
        """Best of the entries below ``i``."""
        value, index = -1e300, -1
        while i > 0:
            if self.best[i] > value:
                value, index = self.best[i], self.at[i]
            i -= i & -i
        return value, index


def chain(xs: list[int], ys: list[int]) -> Iterator[list[int]]:
    """Chains of matches (indexes in rising order), the best first, each match in one.

    ``xs`` must not fall; a chain rises strictly on both sides. A match adds
    ``KMER``; skipping words costs ``GAP_COST`` for each on either side.
    """
    n = len(xs)
    rank = {y: i for i, y in enumerate(sorted(set(ys)))}
    tree, score, back, waiting = Fenwick(len(rank)), [0.0] * n, [-1] * n, []
    for i in range(n):
        while waiting and xs[waiting[-1]] < xs[i]:  # matches at one position never follow each other
            for j in waiting:
                tree.put(rank[ys[j]], score[j] + GAP_COST * (xs[j] + ys[j]), j)
            waiting.clear()
        value, j = tree.before(rank[ys[i]])
        gain = value - GAP_COST * (xs[i] + ys[i])
        score[i], back[i] = (KMER + gain, j) if gain > 0 else (float(KMER), -1)
        waiting.append(i)
    used = [False] * n
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        links = []
        while i >= 0 and not used[i]:
            used[i] = True
            links.append(i)
            i = back[i]
        if links:
            yield links[::-1]


def spans(xs: list[int], ys: list[int]) -> Iterator[tuple[list[int], list[int], list[int]]]:
    """For each chain, cut at large gaps: starts on both sides and lengths of its stretches of one diagonal."""
    for links in chain(xs, ys):
        sx, sy, sn = [], [], []
        for i in links:
            x, y = xs[i], ys[i]
            if sx and max(x - sx[-1] - sn[-1], y - sy[-1] - sn[-1]) > GAP:
                yield sx, sy, sn
                sx, sy, sn = [], [], []
            if sx and x - y == sx[-1] - sy[-1]:
                sn[-1] = x - sx[-1] + KMER
            else:
                sx.append(x)
                sy.append(y)
                sn.append(KMER)
        if sx:
            yield sx, sy, sn


def find_chains(matches: DataFrame) -> DataFrame:
    """(doc, other, sx, sy, sn) from matches (doc, pos, other, other_pos)."""
    enough = WORDS - 2 * (WINDOW - 1)
    lists = pa.list_(pa.int32())
    schema = pa.schema([("doc", pa.int64()), ("other", pa.int64()), ("sx", lists), ("sy", lists), ("sn", lists)])

    def chained(key, xs, ys):
        return [(*key, *found) for found in spans(xs, ys) if found[0][-1] + found[2][-1] - found[0][0] >= enough]

    def run(batches):
        memo("chaining")
        held: tuple | None = None
        for rows in batches:
            doc, other, x, y = (rows.column(c).to_numpy() for c in ("doc", "other", "pos", "other_pos"))
            if not len(doc):
                continue
            edges = np.concatenate([[0], np.flatnonzero((doc[1:] != doc[:-1]) | (other[1:] != other[:-1])) + 1, [len(doc)]]).tolist()
            xs, ys, out = x.tolist(), y.tolist(), []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                key = (int(doc[a]), int(other[a]))
                if held and held[0] == key:
                    held[1].extend(xs[a:b])
                    held[2].extend(ys[a:b])
                    continue
                if held:
                    out += chained(*held)
                held = (key, xs[a:b], ys[a:b])
            if out:
                yield batch(schema, **dict(zip(schema.names, zip(*out, strict=True), strict=True)))
        if held and (out := chained(*held)):
            yield batch(schema, **dict(zip(schema.names, zip(*out, strict=True), strict=True)))

    # A seed may stand at several places of a document: strictly rising chains need rising xs only.
    dealt = matches.repartition("doc", "other").sortWithinPartitions("doc", "other", "pos", "other_pos")
    return dealt.mapInArrow(run, "doc bigint, other bigint, sx array<int>, sy array<int>, sn array<int>")


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum(row[1:], row[:-1] + (b == x))
        np.maximum.accumulate(row, out=row)
    return int(row[-1])


def outwards(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(words, agreeing words) to extend by along a diagonal: up to the best sum of +1 and -2, given up 8 below it."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    same = a[:n] == b[:n]
    sums = np.cumsum(np.where(same, 1, -2))
    dropped = np.flatnonzero(np.maximum.accumulate(np.maximum(sums, 0)) - sums > 8)
    sums = sums[: dropped[0]] if len(dropped) else sums
    if not len(sums) or sums.max() <= 0:
        return 0, 0
    best = int(sums.argmax()) + 1
    return best, int(same[:best].sum())


def align(a: np.ndarray, a0: int, b: np.ndarray, b0: int, sx: list[int], sy: list[int], sn: list[int]) -> tuple[int, int, int, int, int]:
    """(x0, x1, y0, y1, agreeing words) of a chain on the words ``a`` from ``a0`` on and ``b`` from ``b0`` on."""
    agree, x, y = 0, sx[0], sy[0]
    for i, (p, q, n) in enumerate(zip(sx, sy, sn, strict=True)):
        cut = max(0, x - p, y - q) if i else 0  # a stretch may begin inside the one before
        if cut >= n:
            continue
        p, q, n = p + cut, q + cut, n - cut
        if p > x and q > y:
            agree += common(a[x - a0 : p - a0], b[y - b0 : q - b0])
        agree += int(np.count_nonzero(a[p - a0 : p + n - a0] == b[q - b0 : q + n - b0]))
        x, y = p + n, q + n
    left, same = outwards(a[: sx[0] - a0][::-1], b[: sy[0] - b0][::-1])
    right, more = outwards(a[x - a0 :], b[y - b0 :])
    return sx[0] - left, x + right, sy[0] - left, y + right, agree + same + more


def one_text_per_id(docs: DataFrame) -> DataFrame:
    """(doc_id, text, crc) with unique ids: of several rows, the one whose text has the least checksum."""
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("crc", F.crc32("text"))
    shared = materialize(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if shared.isEmpty():
        return rows
    shared = bounded_broadcast(shared)
    chosen = rows.join(shared, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("crc", "text")).alias("r")).select("doc_id", "r.text", "r.crc")
    return rows.join(shared, "doc_id", "left_anti").unionByName(chosen)


def passages(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, start_word, end_word, other_doc_id, other_start, other_end, n_words, identity).

    Each row says that words [start_word, end_word) of doc_id repeat those of
    other_doc_id, the smaller id. Requests that measure more than
    ``broadcast_bytes`` are joined by shuffle.
    """
    docs = one_text_per_id(docs)
    found = find_seeds(docs)
    first = found.groupBy("seed").agg(F.min(F.struct("doc", "pos")).alias("f"), F.max("doc").alias("last")).where("last <> f.doc")
    first = materialize(first.select("seed", F.col("f.doc").alias("other"), F.col("f.pos").alias("other_pos")))
    shared = materialize(found.join(first, "seed").select("seed", "doc", "pos", "other", "other_pos"))
    out = materialize(aligned_chains(docs, find_chains(shared.where("doc <> other")), broadcast_bytes))
    out = materialize(out.unionByName(run_passages(docs, shared, out, broadcast_bytes)))
    paired = materialize(joined_pairs(close_pairs(shared, out)))
    return out if paired.isEmpty() else out.unionByName(aligned_chains(docs, find_chains(paired), broadcast_bytes))


def run_passages(docs: DataFrame, shared: DataFrame, out: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``passages`` that come of runs of ``WORDS`` words outside those of ``out``."""
    nothing = out.limit(0)
    places = materialize(open_runs(shared, out))
    asking = places.where("size(open_from) > 0")
    if asking.isEmpty():
        return nothing
    asking = materialize(find_runs(docs, asking.select("doc_id", F.col("open_from").alias("from"), F.col("open_to").alias("to")), broadcast_bytes))
    wanted = bounded_broadcast(materialize(asking.select("run").distinct()), broadcast_bytes)
    holders = find_runs(docs, places.select("doc_id", "from", "to"), broadcast_bytes).join(wanted, "run", "left_semi")
    holders = holders.groupBy("run").agg(F.min(F.struct("doc", "pos")).alias("f")).select("run", F.col("f.doc").alias("other"), F.col("f.pos").alias("other_pos"))
    holders = bounded_broadcast(materialize(holders), broadcast_bytes)
    copied = materialize(asking.join(holders, "run").where("doc <> other").select("doc", "pos", "other", "other_pos"))
    if copied.isEmpty():
        return nothing
    return aligned_chains(docs, joined_runs(copied), broadcast_bytes)


def close_pairs(shared: DataFrame, found: DataFrame) -> DataFrame:
    """(key, doc, pos, next, ask, tried) of the pairs of shared seeds that a chain may link.

    A pair asks if no passage covers either seed. ``tried`` is the first holder of
    both seeds, if they have the same: the two have met there already.
    """
    marks = shared.groupBy(F.col("doc").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("pos", "seed", "other"))).alias("at")).select("doc_id", "at.pos", "at.seed", "at.other")
    covered = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("spans"))
    schema = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("pos", pa.int32()), ("next", pa.int32()), ("ask", pa.bool_()), ("tried", pa.int64())])

    def run(batches):
        memo("chaining")
        for rows in batches:
            for doc, at, seed, other, covers in zip(*(rows.column(x) for x in ("doc_id", "pos", "seed", "other", "spans")), strict=True):
                at, seed, other = (x.values.to_numpy() for x in (at, seed, other))
                free = np.ones(len(at), bool)
                for x in covers.as_py() or []:
                    free[np.searchsorted(at, x["start_word"]) : np.searchsorted(at, x["end_word"] - KMER, "right")] = False
                found, j = [], 1
                while j < len(at) and len(i := np.flatnonzero(at[j:] - at[:-j] <= KMER + GAP)):
                    found.append((i, i + j))
                    j += 1
                if found:
                    a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
                    yield batch(schema, key=pair(seed[a].view(np.uint64), seed[b].view(np.uint64)).view(np.int64), doc=np.full(len(a), doc.as_py()), pos=at[a], next=at[b], ask=free[a] & free[b], tried=pa.array(other[a], mask=other[a] != other[b]))

    return marks.join(covered, "doc_id", "left").mapInArrow(run, "key bigint, doc bigint, pos int, next int, ask boolean, tried bigint")


def joined_pairs(pairs: DataFrame) -> DataFrame:
    """Matches (doc, pos, other, other_pos) of the seeds of asking pairs with the first holder of the pair."""
    first = pairs.groupBy("key").agg(F.min(F.struct("doc", "pos", "next")).alias("f"), F.max(F.when(F.col("ask"), F.col("doc"))).alias("last")).where("last <> f.doc").select("key", "f")
    met = pairs.where("ask").join(first, "key").where("doc <> f.doc and not (tried <=> f.doc)")
    both = F.inline(F.array(F.struct(F.col("pos").alias("pos"), F.col("f.pos").alias("other_pos")), F.struct(F.col("next").alias("pos"), F.col("f.next").alias("other_pos"))))
    return met.select("doc", F.col("f.doc").alias("other"), both).select("doc", "pos", "other", "other_pos").distinct()


def open_runs(shared: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, from, to, open_from, open_to): ranges of the runs of ``WORDS`` words whose seeds are all shared, and of those that may repeat a smaller document outside passages.

    A run has ``WORDS - KMER - WINDOW + 2`` windows of k-mers, and a copy of it
    chooses the same seed from each: shared seeds at most ``WINDOW`` apart. If a run
    has all windows around a seed, every document with the run chooses that seed
    too; so if the seed's first holder is its own document, no smaller one has the run.
    """
    windows = WORDS - KMER - WINDOW + 2
    own = F.sort_array(F.collect_set(F.when(F.col("doc") == F.col("other"), F.col("pos")))).alias("own")
    marks = shared.groupBy(F.col("doc").alias("doc_id")).agg(F.sort_array(F.collect_set("pos")).alias("at"), own)
    covered = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("spans"))
    schema = pa.schema([("doc_id", pa.int64()), *((x, pa.list_(pa.int32())) for x in ("from", "to", "open_from", "open_to"))])

    def run(batches):
        memo("chaining")
        for rows in batches:
            out = []
            for doc, at, own, covers in zip(*(rows.column(x).to_pylist() for x in ("doc_id", "at", "own", "spans")), strict=True):
                at, own = np.array(at), np.array(own, np.int64)
                cuts = np.flatnonzero(np.diff(at) > WINDOW)
                lo, hi = np.maximum(at[np.concatenate([[0], cuts + 1])] - WINDOW + 1, 0), at[np.append(cuts, len(at) - 1)] - windows + 2
                lo, hi = lo[hi > lo], hi[hi > lo]
                if not len(lo):
                    continue
                free, end = np.zeros(int(hi[-1]) + 1, np.int64), 0
                np.add.at(free, lo, 1)
                np.add.at(free, hi, -1)
                first = np.zeros(len(free) + 1, np.int64)
                np.add.at(first, np.clip(own - windows + 1, 0, len(free)), 1)
                np.add.at(first, np.clip(own - WINDOW + 2, 0, len(free)), -1)
                free, a = (np.cumsum(free) > 0) & (np.cumsum(first)[:-1] == 0), 0
                for x in covers or []:
                    if x["start_word"] > end:
                        a = x["start_word"]
                    end = max(end, x["end_word"])
                    free[a : max(a, end - WORDS + 1)] = False
                edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
                out.append((doc, lo, hi, edges[::2], edges[1::2]))
            if out:
                yield batch(schema, **dict(zip(schema.names, zip(*out, strict=True), strict=True)))

    ranges = "array<int>, ".join(["from ", "to ", "open_from ", "open_to "]) + "array<int>"
    return marks.join(covered, "doc_id", "left").mapInArrow(run, f"doc_id bigint, {ranges}")


def find_runs(docs: DataFrame, places: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(run, doc, pos) of the runs of ``WORDS`` words that begin in the ranges ``from`` to ``to`` of each document."""
    schema = pa.schema([("run", pa.int64()), ("doc", pa.int64()), ("pos", pa.int32())])

    def run(batches):
        for rows in batches:
            data, offsets = utf8(rows.column("text"))
            ids, froms, tos = rows.column("doc_id").to_numpy(), rows.column("from"), rows.column("to")
            for lo, hi in stretches(offsets):
                text, starts, ends, bounds = words(data, offsets[lo : hi + 1])
                hashed = word_runs(hashes(text, starts, ends), WORDS)
                for i in range(lo, hi):
                    begin, last = int(bounds[i - lo]), int(bounds[i - lo + 1] - bounds[i - lo]) - WORDS + 1
                    pos = [np.arange(a, min(b, last)) for a, b in zip(froms[i].as_py(), tos[i].as_py(), strict=True) if a < last]
                    if pos:
                        pos = np.concatenate(pos)
                        yield batch(schema, run=hashed[begin + pos].view(np.int64), doc=np.full(len(pos), ids[i]), pos=pos.astype(np.int32))

    picked = docs.join(bounded_broadcast(places, broadcast_bytes), "doc_id").select("doc_id", "text", "from", "to")
    return picked.mapInArrow(run, "run bigint, doc bigint, pos int")


def joined_runs(copied: DataFrame) -> DataFrame:
    """Chains (doc, other, sx, sy, sn) of one stretch each, from equal runs (doc, pos, other, other_pos) that follow one another."""
    line = Window.partitionBy("doc", "other", "shift").orderBy("pos")
    begun = copied.withColumn("shift", F.col("pos") - F.col("other_pos")).withColumn("new", (F.col("pos") - F.lag("pos", 1, -2).over(line) > 1).cast("int"))
    whole = begun.withColumn("part", F.sum("new").over(line)).groupBy("doc", "other", "shift", "part").agg(F.min("pos").alias("x"), (F.max("pos") - F.min("pos") + WORDS).alias("n"))
    return whole.select("doc", "other", F.array("x").alias("sx"), F.array(F.col("x") - F.col("shift")).alias("sy"), F.array("n").alias("sn"))


def aligned_chains(docs: DataFrame, chains: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``passages`` that come of chains (doc, other, sx, sy, sn)."""
    chains = materialize(materialize(chains).withColumn("chain", F.monotonically_increasing_id()))
    end = F.element_at("sx", -1) + F.element_at("sn", -1), F.element_at("sy", -1) + F.element_at("sn", -1)
    wanted = F.array(*[F.struct(F.lit(side).alias("side"), F.col(who).alias("doc_id"), F.greatest(F.element_at(s, 1) - MARGIN, F.lit(0)).alias("a"), (e + MARGIN).alias("b")) for side, who, s, e in ((0, "doc", "sx", end[0]), (1, "other", "sy", end[1]))])
    asked = chains.select("chain", F.explode(wanted).alias("w")).select("w.doc_id", F.struct("chain", "w.side", "w.a", "w.b").alias("ask"))
    # A much repeated original is asked for by many chains: so many to a row, each with its copy of the text.
    asked = materialize(_grouped(asked))
    slices = docs.join(bounded_broadcast(asked, broadcast_bytes), "doc_id").select("text", "chain", "side", "a", "b")
    schema = pa.schema([("chain", pa.int64()), ("side", pa.int32()), ("at", pa.int32()), ("words", pa.binary())])

    def cut(batches):
        for rows in batches:
            data, offsets = utf8(rows.column("text"))
            asks = list(zip(*(rows.column(x).to_pylist() for x in ("chain", "side", "a", "b")), strict=True))
            for lo, hi in stretches(offsets):
                text, starts, ends, bounds = words(data, offsets[lo : hi + 1])
                word = (hashes(text, starts, ends) >> np.uint64(48)).astype("<u2")
                out = []
                for i in range(lo, hi):
                    own = word[bounds[i - lo] : bounds[i - lo + 1]]
                    out += [(number, side, a, own[a:b].tobytes()) for number, side, a, b in zip(*asks[i], strict=True)]
                if out:
                    yield batch(schema, chain=[x[0] for x in out], side=[x[1] for x in out], at=[x[2] for x in out], words=binaries([x[3] for x in out]))

    slices = slices.mapInArrow(cut, "chain bigint, side int, at int, words binary")
    both = slices.groupBy("chain").agg(*[F.max_by(F.struct("at", "words"), F.when(F.col("side") == i, 1).otherwise(0)).alias(f"s{i}") for i in (0, 1)])
    both = both.join(chains, "chain").select("doc", "other", "sx", "sy", "sn", F.col("s0.at").alias("at0"), F.col("s0.words").alias("words0"), F.col("s1.at").alias("at1"), F.col("s1.words").alias("words1"))
    done = pa.schema([("doc_id", pa.int64()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("other_doc_id", pa.int64()), ("other_start", pa.int32()), ("other_end", pa.int32()), ("n_words", pa.int32()), ("identity", pa.float64())])

    def aligned(batches):
        for rows in batches:
            out = []
            for x in rows.to_pylist():
                a, b = np.frombuffer(x["words0"], "<u2"), np.frombuffer(x["words1"], "<u2")
                x0, x1, y0, y1, agree = align(a, x["at0"], b, x["at1"], x["sx"], x["sy"], x["sn"])
                share = agree / max(x1 - x0, y1 - y0)
                if share < IDENTITY:  # without what the ends were extended by
                    ends = x["sx"][-1] + x["sn"][-1], x["sy"][-1] + x["sn"][-1]
                    inner = [(w[lo - at : hi - at], lo) for w, lo, hi, at in ((a, x["sx"][0], ends[0], x["at0"]), (b, x["sy"][0], ends[1], x["at1"]))]
                    x0, x1, y0, y1, agree = align(*inner[0], *inner[1], x["sx"], x["sy"], x["sn"])
                    share = agree / max(x1 - x0, y1 - y0)
                if x1 - x0 >= WORDS and share >= IDENTITY:
                    out.append((x["doc"], x0, x1, x["other"], y0, y1, x1 - x0, share))
            if out:
                yield batch(done, **dict(zip(done.names, zip(*out, strict=True), strict=True)))

    return both.mapInArrow(aligned, "doc_id bigint, start_word int, end_word int, other_doc_id bigint, other_start int, other_end int, n_words int, identity double")


def _grouped(asked: DataFrame) -> DataFrame:
    """Requests (doc_id, ask) as lists of about ``REQUESTS_PER_ROW`` for each document, a list for each field, which takes a third of the bytes of one list of structs."""
    counts = asked.groupBy("doc_id").agg(F.ceil(F.count("*") / REQUESTS_PER_ROW).alias("deals"))
    dealt = asked.join(counts, "doc_id").withColumn("deal", F.pmod(F.xxhash64("ask.chain"), F.col("deals")))
    return dealt.groupBy("doc_id", "deal").agg(F.collect_list("ask").alias("asks")).select("doc_id", "asks.chain", "asks.side", "asks.a", "asks.b")


def without_repeats(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without the passages that an earlier document has; rows left without words by that go.

    A column n_chars follows the text.
    """
    found = materialize(passages(docs, broadcast_bytes))
    marks = found.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("__spans"))
    marks = marks.join(one_text_per_id(docs).select(F.col("doc_id").alias("__id"), F.col("crc").alias("__crc")), "__id")
    marks = bounded_broadcast(materialize(marks), broadcast_bytes)
    names = docs.columns

    def cut(batches):
        for rows in batches:
            table, spans_ = rows.select(names), rows.column("__spans")
            at = np.flatnonzero(spans_.is_valid().to_numpy(zero_copy_only=False))
            if not len(at):
                yield table
                continue
            texts, keep = table.column("text").to_pylist(), np.ones(len(rows), bool)
            for i in at.tolist():
                texts[i] = remove(texts[i], [(x["start_word"], x["end_word"]) for x in spans_[i].as_py()])
                keep[i] = bool(texts[i].strip(" \t\n\x0b\x0c\r"))
            for name, values in [("text", texts), *([("n_chars", [None if x is None else len(x) for x in texts])] if "n_chars" in names else [])]:
                own = table.schema.get_field_index(name)
                table = table.set_column(own, table.schema.field(own), pa.array(values, table.schema.field(own).type))
            yield table.filter(pa.array(keep))

    marked = docs.join(marks, (docs["doc_id"] == marks["__id"]) & (F.crc32(docs["text"]) == marks["__crc"]), "left").select(*[docs[x] for x in names], "__spans")
    return marked.mapInArrow(cut, docs.schema)


def remove(text: str, ranges: list[tuple[int, int]]) -> str:
    """``text`` without the words of any range, each up to the next word."""
    data = np.frombuffer(text.encode(), np.uint8)
    _, starts, ends, _ = words(data, np.array([0, len(data)]), lower=False)
    gone = np.zeros(len(starts) + 1, np.int64)
    for a, b in ranges:
        gone[a] += 1
        gone[b] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    if gone.all():
        return ""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    kept, last = [], 0
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        kept.append(data[last : starts[a]].tobytes())
        last = int(starts[b]) if b < len(starts) else int(ends[-1])
    kept.append(data[last:].tobytes())
    return b"".join(kept).decode()
