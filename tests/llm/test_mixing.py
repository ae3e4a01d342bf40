import random
import re

import pytest

from tidemark.llm import mixing


def highest_quotients(votes, seats):
    given = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * given[i] + 1), -i))
        given[i] += 1
    return given


@pytest.mark.parametrize("seed", range(40))
def test_seats_equal_the_plain_rule(seed):
    rng = random.Random(seed)
    votes = [rng.choice([rng.random() * 1000, rng.randint(0, 30), 7]) for _ in range(rng.randint(1, 25))]
    votes[0] += 1
    seats = rng.randint(0, 300)
    assert mixing.sainte_lague(votes, seats) == highest_quotients(votes, seats)


def test_targets_reshare_the_excess():
    assert mixing.targets([10, 90, 100], [5, 2, 1]) == [30.0, 170 * 2 / 3, 170 / 3]
    assert sum(mixing.targets([0, 5], [5, 2])) == 5
    assert mixing.targets([], []) == []


def test_mix_meets_targets_and_reruns_agree(documents, odd):
    rng = random.Random(2)
    rows = [(i, t, "en", None if n % 3 else "é") for n, (i, t) in enumerate(odd)]
    rows += [(1000 + i, " ".join(["w"] * rng.choice([5, 80, 700])), "en", f"s{min(9, int(rng.expovariate(0.5)))}") for i in range(900)]
    docs = documents(rows)
    got = [tuple(r) for r in mixing.mix(docs).collect()]
    assert len(got) == len(rows)
    assert sorted(got, key=str) == sorted((tuple(r) for r in mixing.mix(docs.repartition(7)).collect()), key=str)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    want = dict(zip(names, mixing.targets([sizes[n] for n in names], [[5, 2, 1][i % 3] for i in range(len(names))]), strict=True))
    taken = {}
    for _, source, _, size, source_size, target, words in got:
        assert source_size == sizes[source] and target == pytest.approx(want[source]) and 0 <= words <= 3 * size
        taken[source] = taken.get(source, 0) + words
    for n in names:
        assert abs(taken[n] - want[n]) <= max(mixing.BLOCK, 0.01 * want[n])


def test_empty_table_and_texts(documents):
    assert mixing.mix(documents([])).count() == 0
    assert [r["taken"] for r in mixing.mix(documents([(1, None), (2, " ")])).collect()] == [0, 0]


def test_a_source_named_like_no_source(documents):
    rows = [(i, "word " * 40, "en", ("\x00null", None, "", "a")[i % 4]) for i in range(80)]
    got = mixing.mix(documents(rows)).collect()
    assert len(got) == 80 and {r["source"] for r in got} == {"\x00null", None, "", "a"}
    assert all(r["source_size"] == 800 for r in got)


def test_very_many_sources_take_no_longer_than_their_rows(documents):
    rows = [(i, "w " * 5, "en", f"s{i}") for i in range(3000)]
    got = mixing.mix(documents(rows)).collect()
    assert len(got) == 3000 and all(r["taken"] <= 3 * r["size"] for r in got)
