"""Near-duplicates by b-bit MinHash.

Every document gets ``bands * rows`` minima over its set of word shingles. Bands
of full minima propose pairs; the low bits of all minima, packed into a few
longs, then estimate the similarity of a pair by bit counts, corrected for the
minima that agree in their low bits by chance. Pairs whose estimate is less than six
standard deviations below the threshold are confirmed on full sets.

Documents with equal sets form one class and take part once, under their
smallest doc_id. In a bucket of a band the best connected member (the hub) is
held against the rest, so a large group of copies costs its size and not its
square. Two rounds of hubs settle most buckets. In what is left, members outside
a bucket's main component are held against all others in tiles of bounded size,
with longer signatures, whose estimate leaves little to confirm.

Defined results: a document without words has an empty set and no links; fewer
words than a shingle count as one shingle; rows with a null doc_id cannot be
named by a link and stand alone with a null component, kept; rows that share a
doc_id are versions of one document, linked if any version is. Equal sets are
one class whatever their ids. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..joins import bounded_broadcast
from ..session import materialize
from .graph import components
from .text import batch, hashes, memo, mix, pair, stretches, utf8, words

BANDS, ROWS, BITS = 48, 5, 4
HUB_ROUNDS = 2
TILE, LONGER = 512, 2048
#: Texts to confirm that are broadcast, in either of two joins.
TEXT_BYTES = 16 << 20
_SEED = 20240311


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = utf8(column)
    for lo, hi in stretches(offsets):
        text, starts, ends, bounds = words(data, offsets[lo : hi + 1])
        word = hashes(text, starts, ends)
        window = word.copy()
        for j in range(1, width):
            window[: len(word) - j] = pair(window[: len(word) - j], word[j:])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(window[a : b - width + 1])
            elif b > a:
                x = np.uint64([b - a])
                for j in range(a, b):
                    x = pair(x, word[j : j + 1])
                yield mix(~x)
            else:
                yield word[:0]


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    return rng.integers(0, 1 << 32, count, dtype=np.uint32), rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minima(elements: np.ndarray, flips: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least value of a set under each permutation of 32-bit values."""
    least = np.full(len(flips), 0xFFFFFFFF, np.uint32)
    high = (elements >> np.uint64(32)).astype(np.uint32)
    for lo in range(0, len(high), 2048):
        values = high[lo : lo + 2048, None] ^ flips
        values *= factors
        np.minimum(least, values.min(axis=0), out=least)
    return least


def packed_bits(least: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of all minima of each document (a row), as int64 words."""
    low = ((least[:, :, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
    return np.packbits(low.reshape(len(least), -1), axis=1, bitorder="little").view("<i8")


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grouped = least.reshape(len(least), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(least), bands))
    for j in range(rows):
        key = pair(key, grouped[:, :, j])
    return key.view(np.int64)


def signatures(docs: DataFrame, width: int, bands: int, rows: int, bits: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, s0.., keys) per document; d1 and d2 digest the set."""
    longs = bands * rows * bits // 64
    assert longs * 64 == bands * rows * bits and bits in (1, 2, 4, 8), "signatures must fill whole longs"
    names = [f"s{i}" for i in range(longs)]
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), *[(x, pa.int64()) for x in names], ("keys", pa.list_(pa.int64()))])

    def run(batches):
        memo("minhash")
        flips, factors = _permutations(bands * rows)
        step = max(32, 200_000 // (bands * rows))
        for table in (x.slice(lo, step) for x in batches for lo in range(0, x.num_rows, step)):
            least = np.empty((table.num_rows, bands * rows), np.uint32)
            counts, digests = np.zeros(table.num_rows, np.int64), np.zeros((2, table.num_rows), np.uint64)
            for i, elements in enumerate(shingle_sets(table.column("text"), width)):
                counts[i] = len(elements)
                least[i] = minima(elements, flips, factors)
                digests[0, i], digests[1, i] = elements.sum(), (elements * (elements | np.uint64(1))).sum()
            digests = mix(digests).view(np.int64)
            packed, keys = packed_bits(least, bits), band_keys(least, bands, rows)
            ends = np.concatenate([[0], np.cumsum(np.where(counts > 0, bands, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[counts > 0].ravel()))
            yield batch(schema, doc_id=table.column("doc_id"), n_shingles=counts, d1=digests[0], d2=digests[1], keys=lists, **{x: packed[:, i] for i, x in enumerate(names)})

    typed = ", ".join(f"{x} bigint" for x in ["doc_id", "n_shingles", "d1", "d2", *names])
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, f"{typed}, keys array<bigint>")


def _fields(name: str):
    return lambda c: F.col(f"{name}.{c}")


def _differ(x, y, longs: int, bits: int) -> Column:
    """Minima that differ in their low bits; ``x`` and ``y`` give a side's column by name.

    They differ where a lane of the XOR of the packed bits has any bit set.
    """
    differ = F.lit(0)
    for i in range(longs):
        differ = differ + F.bit_count(_differing(x(f"s{i}").bitwiseXOR(y(f"s{i}")), bits))
    return differ


def _differing(z: Column, bits: int) -> Column:
    """One bit for each lane of ``bits`` bits with any bit set."""
    lanes = int("".join(["0" * (bits - 1) + "1"] * (64 // bits)), 2)
    for shift in (s for s in (1, 2, 4) if s < bits):
        z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
    return z.bitwiseAND(F.lit(lanes if lanes < 1 << 63 else lanes - (1 << 64)))


def _most(percent: int, size: int, bits: int) -> float:
    """Differing minima of ``size`` that a pair at the threshold stays below by six deviations."""
    chance = 2.0**-bits
    agree = chance + (1 - chance) * percent / 100
    return size * (1 - agree) + 6 * math.sqrt(size * agree * (1 - agree))


def _plausible(x, y, percent: int, size: int, longs: int, bits: int) -> Column:
    """Set sizes allow the similarity, and so does the corrected estimate plus six deviations."""
    return (F.least(x("n"), y("n")) * 100 >= F.greatest(x("n"), y("n")) * percent) & (_differ(x, y, longs, bits) <= _most(percent, size, bits))


def confirm(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    needed = materialize(docs.join(bounded_broadcast(materialize(ids)), "doc_id", "left_semi"))
    left, right = (needed.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")

    def run(batches):
        memo("minhash")
        for table in batches:
            sides = zip(shingle_sets(table.column("text_a"), width), shingle_sets(table.column("text_b"), width), strict=True)
            same = []
            for x, y in sides:
                common = len(np.intersect1d(x, y, assume_unique=True))
                same.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield table.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    # A side that measures small goes to the pairs; else the pairs' texts go through two shuffles.
    left, right = (bounded_broadcast(x, TEXT_BYTES) for x in (left, right))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size, longs = bands * rows, bands * rows * bits // 64
    names = [f"s{i}" for i in range(longs)]
    of_set = ["d1", "d2", "n_shingles"]
    signed = materialize(signatures(docs, width, bands, rows, bits))
    full = signed.where("n_shingles > 0 and doc_id is not null").select("doc_id", *of_set)
    classes = full.groupBy(*of_set).agg(F.min("doc_id").alias("rep"))
    classed = materialize(full.join(classes, of_set))
    copies = bounded_broadcast(materialize(classed.where("doc_id <> rep").select("doc_id", "d1", "d2").distinct()))
    firsts = signed.where("n_shingles > 0 and doc_id is not null").join(copies, ["doc_id", "d1", "d2"], "left_anti")

    keys = firsts.select(F.explode("keys").alias("key"), F.col("doc_id").alias("rep"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = materialize(keys.join(sizes, "key"))
    # The member that meets the most others is the likeliest original of its group.
    weights = buckets.groupBy("rep").agg(F.sum("size").alias("weight"))
    members = firsts.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "d1", "d2", *names, "keys")
    members = materialize(members.join(weights, "rep"))
    buckets = buckets.select("key", "rep").join(weights, "rep").withColumn("comp", F.col("rep"))

    links = tested = None
    for turn in range(HUB_ROUNDS + 1):
        if turn:
            named = components(links)
            buckets = buckets.drop("comp").join(named, F.col("rep") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "rep")).drop("node", "component")
            mixed = buckets.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
            buckets = materialize(buckets.join(mixed, "key"))
            if buckets.isEmpty():
                break
        if turn < HUB_ROUNDS:
            hubs = buckets.groupBy("key").agg(F.max_by(F.struct(F.col("rep").alias("hub"), F.col("comp").alias("hub_comp")), F.struct("weight", F.bitwise_not("rep"))).alias("h")).select("key", "h.*")
            facing = materialize(buckets.join(hubs, "key").where("rep <> hub"))
            pairs = facing.where("comp <> hub_comp").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
            x, y = (members.select(F.col("rep").alias(side), F.struct("n", *names).alias(f"of_{side}")) for side in "ab")
            found = pairs.join(x, "a").join(y, "b").where(_plausible(_fields("of_a"), _fields("of_b"), percent, size, longs, bits)).select("a", "b")
            buckets = facing.drop("hub", "hub_comp")
        else:
            found = _tiles(buckets, members, longer_signatures(buckets, members, docs, width, bits), percent, size, longs, bits)
        if tested is not None:
            found = found.join(tested, ["a", "b"], "left_anti")
        found = materialize(found)
        tested = found if tested is None else tested.union(found)
        more = materialize(confirm(found, docs, width, percent))
        links = more if links is None else links.union(more)

    named = components(links)
    of_class = classed.join(named, F.col("rep") == F.col("node"), "left").select("doc_id", *of_set, F.coalesce("component", "rep").alias("component_id"))
    # Versions of one doc_id may lie in several classes: those are one component too.
    shared = classed.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    merged = components(of_class.join(shared, "doc_id").where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")))
    of_class = of_class.join(merged, F.col("component_id") == F.col("node"), "left").withColumn("component_id", F.coalesce("component", "component_id"))
    alone = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = of_class.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def longer_signatures(buckets: DataFrame, members: DataFrame, docs: DataFrame, width: int, bits: int) -> DataFrame:
    """(rep, d1, d2, longer): ``LONGER`` minima for each version of the few members of unsettled buckets, which tell close calls apart."""
    wanted = members.join(buckets.select("rep").distinct(), "rep", "left_semi").select(F.col("rep").alias("doc_id"), "d1", "d2")
    texts = docs.join(bounded_broadcast(materialize(wanted.select("doc_id").distinct())), "doc_id", "left_semi")
    longs = LONGER * bits // 64
    signed = signatures(texts, width, LONGER // 8, 8, bits).select("doc_id", "d1", "d2", F.array(*[f"s{i}" for i in range(longs)]).alias("longer"))
    return materialize(signed.join(wanted, ["doc_id", "d1", "d2"]).select(F.col("doc_id").alias("rep"), "d1", "d2", "longer").dropDuplicates(["rep", "d1", "d2"]))


def _tiles(buckets: DataFrame, members: DataFrame, longer: DataFrame, percent: int, size: int, longs: int, bits: int) -> DataFrame:
    """Plausible pairs of different components in a bucket, each once, in tiles of about ``TILE`` by ``TILE``.

    The members outside a bucket's main component meet all members inside it
    and one another. A pair is given by the first band that both share, if the
    longer signatures find it plausible too.
    """
    counts = buckets.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mains = counts.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("inside"), F.sum("n").alias("all"))
    grid = F.ceil(F.col("inside") / TILE).cast("int"), F.ceil((F.col("all") - F.col("inside")) / TILE).cast("int")
    placed = buckets.join(mains, "key").select("key", "rep", "comp", (F.col("comp") != F.col("main")).alias("out"), grid[0].alias("across"), grid[1].alias("down"))
    placed = placed.withColumn("t", F.pmod(F.xxhash64("rep"), F.when(F.col("out"), F.col("down")).otherwise(F.col("across"))).cast("int"))
    step = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    inside = F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda i: step(0, i, F.col("t")))
    outside = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("across") - 1), lambda j: step(0, F.col("t"), j)),
        F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda o: step(1, F.least(o, F.col("t")), F.greatest(o, F.col("t")))),
    )
    spread = placed.withColumn("tile", F.explode(F.when(F.col("out"), outside).otherwise(inside)))
    low = F.array(*[f"s{i}" for i in range(longs)]).alias("low")
    of_rep = members.select("rep", "d1", "d2", "n", low, "keys").join(longer, ["rep", "d1", "d2"]).drop("d1", "d2")
    # Dealt before the signatures join: where those measure small, only names are shuffled.
    spread = spread.select("rep", "comp", "out", "t", "key", "tile.*").repartition("key", "kind", "i", "j")
    spread = spread.join(bounded_broadcast(materialize(of_rep)), "rep")
    most = _most(percent, size, bits), _most(percent, LONGER, bits)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def close(of_tile, rows):
        import pyarrow.compute as pc

        key, kind, i, j = (x.as_py() for x in of_tile)
        out, t = (rows.column(x).combine_chunks() for x in ("out", "t"))
        x = rows.filter(pc.and_(out, pc.equal(t, i)))
        y = rows.filter(pc.and_(out, pc.equal(t, j)) if kind else pc.invert(out))
        (rep_x, comp_x, n_x, *long_x), (rep_y, comp_y, n_y, *long_y) = (
            [*(side.column(c).to_numpy() for c in ("rep", "comp", "n")), *(_lists(side.column(c)) for c in ("keys", "low", "longer"))] for side in (x, y)
        )
        a, b = [], []
        for k in range(len(rep_x)):
            near = np.minimum(n_y, n_x[k]) * 100 >= np.maximum(n_y, n_x[k]) * percent
            if kind:
                near &= comp_y != comp_x[k]
                near &= (rep_y > rep_x[k]) | (i < j)
            at = np.flatnonzero(near)
            shared = long_y[0][at] == long_x[0][k]
            at = at[long_x[0][k][shared.argmax(axis=1)] == key] if len(at) else at
            for z, mine, limit in zip(long_y[1:], long_x[1:], most, strict=True):
                at = at[_lanes(z[at] ^ mine[k], bits) <= limit]
            a.append(np.minimum(rep_y[at], rep_x[k]))
            b.append(np.maximum(rep_y[at], rep_x[k]))
        return pa.Table.from_arrays([pa.array(np.concatenate([*c, rep_x[:0]]), pa.int64()) for c in (a, b)], schema=schema)

    return spread.groupBy("key", "kind", "i", "j").applyInArrow(close, "a bigint, b bigint").distinct()


def _lists(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of longs, all of one length, as the rows of a matrix."""
    column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.int64)


def _lanes(z: np.ndarray, bits: int) -> np.ndarray:
    """For each row, lanes of ``bits`` bits with any bit set; the twin of ``_differing`` for numpy."""
    z = z.view(np.uint64)
    for shift in (s for s in (1, 2, 4) if s < bits):
        z = z | z >> np.uint64(shift)
    lanes = np.uint64(int("".join(["0" * (bits - 1) + "1"] * (64 // bits)), 2))
    return np.bitwise_count(z & lanes).sum(axis=1, dtype=np.int64)


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each group the document with the smallest id.

    Of several rows with that id and one text, one stays.
    """
    found = near_duplicates(docs, width, percent)
    gone = bounded_broadcast(materialize(found.where("not kept").select(F.col("doc_id").alias("__id")).distinct()))
    left = docs.join(gone, docs["doc_id"] == gone["__id"], "left_anti")
    repeated = materialize(left.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("n")).where("n > 1").select("__id"))
    if repeated.isEmpty():
        return left
    repeated = bounded_broadcast(repeated)
    once = left.join(repeated, left["doc_id"] == repeated["__id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(repeated, left["doc_id"] == repeated["__id"], "left_anti").unionByName(once)
