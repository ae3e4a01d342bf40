import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import graph, minhash
from tidemark.llm.graph import components


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    out = []
    for i, a in sets:
        component = i if not a or i is None else find(i)
        out.append((i, len(a), component, i is None or i == component))
    return sorted(out, key=str)


def edited(rng, words, share):
    return " ".join(f"e{rng.random():.9f}" if rng.random() < share else w for w in words)


@pytest.mark.parametrize("k", [2, 5])
def test_equals_brute_force(documents, odd, k):
    rng = random.Random(7)
    rows = [x for x in odd]
    for g in range(4):
        base = [f"w{rng.randrange(5000)}" for _ in range(60 + 40 * g)]
        rows += [(1000 * (g + 1) + i, edited(rng, base, rng.choice([0.0, 0.01, 0.03, 0.06, 0.2]))) for i in range(40)]
    rows += [(9000 + i, " ".join(f"u{rng.randrange(9000)}" for _ in range(50))) for i in range(40)]
    got = sorted(map(tuple, minhash.near_duplicates(documents(rows), width=k).collect()), key=str)
    assert got == brute(rows, k, 80)


def test_large_groups_go_through_tiles(documents, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 8)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, edited(rng, base, 0.02 + 0.09 * (i % 3 == 0))) for i in range(150)]
    got = sorted(map(tuple, minhash.near_duplicates(documents(rows), width=2).collect()), key=str)
    assert got == brute(rows, 2, 80)


def test_versions_of_one_id_are_one_document(documents):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (2, a), (2, b), (3, b), (4, "else")]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(documents(rows)).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)}


def test_each_version_keeps_its_own_longer_signature(documents):
    rng = random.Random(9)
    bases = [[f"{x}{i}" for i in range(100)] for x in "ab"]
    rows = [(1, " ".join(bases[0])), (1, " ".join(bases[1])), (2, edited(rng, bases[0], 0.01)), (3, edited(rng, bases[1], 0.01))]
    docs, longs = documents(rows).select("doc_id", "text").cache(), minhash.BANDS * minhash.ROWS * minhash.BITS // 64
    signed = minhash.signatures(docs, 2, minhash.BANDS, minhash.ROWS, minhash.BITS).withColumnsRenamed({"doc_id": "rep", "n_shingles": "n"}).cache()
    buckets = signed.selectExpr("explode(keys) AS key", "rep", "rep AS comp")
    longer = minhash.longer_signatures(buckets, signed, docs, 2, minhash.BITS)
    found = minhash._tiles(buckets, signed, longer, 80, minhash.BANDS * minhash.ROWS, longs, minhash.BITS)
    assert set(map(tuple, found.collect())) == {(1, 2), (1, 3)}


def test_empty_table(documents):
    assert minhash.near_duplicates(documents([])).count() == 0


def test_estimate_is_close():
    rng = np.random.default_rng(2)
    flips, factors = minhash._permutations(240)
    errors = []
    for _ in range(60):
        both, rest = rng.integers(0, 1 << 63, 300, dtype=np.uint64), rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        least = np.array([minhash.minima(np.concatenate([both, x]), flips, factors) for x in (rest[:50], rest[50:])])
        bits = np.unpackbits(minhash.packed_bits(least, 4).view(np.uint8), axis=1, bitorder="little").reshape(2, -1, 4)
        agree = (bits[0] == bits[1]).all(axis=1).mean()
        errors.append((agree - 1 / 16) / (15 / 16) - 300 / 400)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_components_of_paths_stars_and_circles(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 200)] + [(700 + i, 700 + (i + 1) % 9) for i in range(9)]
    order = list(range(1000))
    rng.shuffle(order)
    links = [(order[a], order[b]) for a, b in links]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    for nodes in (range(100, 161), range(500, 700), range(700, 709)):
        nodes = [order[i] for i in nodes]
        assert {got[i] for i in nodes} == {min(nodes)}


def test_components_of_several_pieces(spark, monkeypatch):
    monkeypatch.setattr(graph, "PIECE", 40)
    rng = random.Random(4)
    links = [(min(x), max(x)) for x in ([rng.randrange(300), 300 + rng.randrange(300)] for _ in range(350))]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint").repartition(9)).collect()))
    least = {x: x for pair in links for x in pair}
    for _ in least:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert got == least


def test_components_of_few_links_take_few_jobs(spark):
    sc = spark.sparkContext
    order = random.Random(5).sample(range(400), 400)
    links = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a bigint, b bigint").localCheckpoint()
    sc.setJobGroup("components", "")
    found = components(links)
    sc.setLocalProperty("spark.jobGroup.id", None)
    # Each step of a search by joins is several jobs of as many tasks as a shuffle has.
    assert len(sc.statusTracker().getJobIdsForGroup("components")) <= 4
    assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(400)}


def test_least_and_greatest_ids(documents):
    rows = [(i, "a b c d e f g h") for i in (-(2**63), 2**63 - 1, 0)] + [(5, "other words than those")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(documents(rows)).collect()}
    assert got == {-(2**63): -(2**63), 2**63 - 1: -(2**63), 0: -(2**63), 5: 5}

def test_a_large_unsettled_bucket_moves_few_copies_of_its_members(spark):
    """A bucket of 1024 members, half of them outside its main component: each member goes to few tiles."""
    import numpy as np

    ids = spark.range(1024).select(F.col("id").alias("rep"), F.lit(1).cast("bigint").alias("key"), F.when(F.col("id") < 512, 0).otherwise(F.col("id")).alias("comp"))
    # Outside, each second member equals the one inside that is 512 before it.
    value = F.when((F.col("id") >= 512) & (F.col("id") % 2 == 0), F.col("id") - 512).otherwise(F.col("id"))
    row = spark.range(1024).select(F.col("id").alias("rep"), F.lit(0).cast("bigint").alias("d1"), F.lit(0).cast("bigint").alias("d2"), F.lit(100).cast("bigint").alias("n"),
        *[F.xxhash64(value, F.lit(i)).alias(f"s{i}") for i in range(15)], F.array(F.lit(1).cast("bigint")).alias("keys"))
    longer = spark.range(1024).select(F.col("id").alias("rep"), F.lit(0).cast("bigint").alias("d1"), F.lit(0).cast("bigint").alias("d2"), F.array(*[F.xxhash64(value, F.lit(-i)) for i in range(128)]).alias("longer"))
    store, new = spark._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList
    stages = lambda: store.stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), new())
    written = lambda: sum(s.shuffleWriteBytes() for s in (lambda x: [x.apply(i) for i in range(x.size())])(stages()))
    members, longer, before = row.cache(), longer.cache(), None
    members.count(), longer.count()
    before = written()
    got = sorted(map(tuple, minhash._tiles(ids, members, longer, 80, 240, 15, 4).collect()))
    moved = written() - before
    assert got == [(i, i + 512) for i in range(0, 512, 2)]
    assert moved < 7 << 20, moved


def test_members_of_many_unsettled_buckets_move_their_signatures_once(spark):
    """64 members that share 64 buckets; the first bucket gives each pair."""
    rep = spark.range(64).select(F.col("id").alias("rep"), F.lit(0).cast("bigint").alias("d1"), F.lit(0).cast("bigint").alias("d2"))
    value = F.when((F.col("rep") >= 32) & (F.col("rep") % 2 == 0), F.col("rep") - 32).otherwise(F.col("rep"))
    row = rep.select("*", F.lit(100).cast("bigint").alias("n"), *[F.xxhash64(value, F.lit(i)).alias(f"s{i}") for i in range(15)], F.expr("sequence(1L, 64L)").alias("keys"))
    longer = rep.select("*", F.array(*[F.xxhash64(value, F.lit(-i)) for i in range(128)]).alias("longer"))
    buckets = row.select("rep", F.explode("keys").alias("key"), F.when(F.col("rep") < 32, 0).otherwise(F.col("rep")).alias("comp"))
    store, new = spark._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList
    stages = lambda: store.stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), new())
    written = lambda: sum(s.shuffleWriteBytes() for s in (lambda x: [x.apply(i) for i in range(x.size())])(stages()))
    before = written()
    got = sorted(map(tuple, minhash._tiles(buckets, row, longer, 80, 240, 15, 4).collect()))
    moved = written() - before
    assert got == [(i, i + 32) for i in range(0, 32, 2)]
    assert moved < 1 << 20, moved
