import re

import numpy as np

from tidemark.llm import chaining

WORD = r"[^\x20\x09-\x0D]+"


def prose(rng, n):
    return [f"w{x}" for x in rng.integers(0, 40_000, n)]


def test_exact_and_fuzzy_passages_are_found_and_clean_texts_are_not(documents, odd):
    rng = np.random.default_rng(3)
    shared, license_ = prose(rng, 60), prose(rng, 120)
    rows = list(odd)
    for i in range(100, 140):  # clean
        rows.append((i, " ".join(prose(rng, 150))))
    for i in range(200, 206):  # an exact passage of 60 words, in any case
        rows.append((i, " ".join([*prose(rng, 40 + i % 7), *(x.upper() if i % 2 else x for x in shared), *prose(rng, 30)])))
    for i in range(300, 312):  # a fuzzy one: words changed, left out and put in
        fuzzy = list(license_)
        for at in rng.choice(np.arange(25, 100, 26), 2, replace=False):
            fuzzy[at] = "changed"
        if i % 3 == 1:
            del fuzzy[60]
        if i % 3 == 2:
            fuzzy.insert(70, "extra")
        rows.append((i, " ".join([*prose(rng, i % 11), *fuzzy, *prose(rng, 25)])))
    got = chaining.passages(documents(rows, parts=4)).collect()
    assert all(r["other_doc_id"] < r["doc_id"] for r in got)
    assert {r["doc_id"] for r in got if r["doc_id"] < 300} == set(range(201, 206))
    for r in got:
        if 200 < r["doc_id"] < 300:
            assert (r["other_doc_id"], r["n_words"], r["identity"]) == (200, 60, 1.0)
            assert (r["start_word"], r["other_start"]) == (40 + r["doc_id"] % 7, 40 + 200 % 7)
    covered = {}
    for r in got:
        if r["doc_id"] >= 300:
            covered.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    assert set(covered) == set(range(301, 312))
    for i, at in covered.items():
        assert len(at & set(range(i % 11, i % 11 + 118))) >= 100


def test_removal_keeps_first_copy_and_all_columns(documents):
    rng = np.random.default_rng(4)
    passage = " ".join(prose(rng, 80))
    rows = [(1, f"first {passage} rest"), (2, f"second {passage} tail two"), (3, passage), (4, None), (5, ""), (None, passage)]
    docs = documents(rows)
    out = chaining.without_repeats(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert set(got) == {1, 2, 4, 5, None}
    assert got[1]["text"] == rows[0][1] and got[2]["text"].split() == ["second", "tail", "two"] and got[2]["n_chars"] == len(got[2]["text"])
    assert got[None]["text"] == passage


def test_many_copies_give_one_row_each(documents):
    rng = np.random.default_rng(6)
    text = " ".join(prose(rng, 100))
    got = chaining.passages(documents([(i, text) for i in range(600)])).collect()
    assert len(got) == 599 and {r["other_doc_id"] for r in got} == {0}


def test_passage_of_pieces_that_stand_elsewhere_first(documents):
    rng = np.random.default_rng(12)
    passage = prose(rng, 90)
    pieces = [passage[i : i + 30] for i in range(0, 90, 30)]
    rows = [(i, " ".join([*prose(rng, 40), *piece, *prose(rng, 40)])) for i, piece in enumerate(pieces)]
    rows += [(10, " ".join([*prose(rng, 20), *passage, *prose(rng, 25)])), (11, " ".join([*prose(rng, 33), *passage, *prose(rng, 5)]))]
    # One document has the pieces apart, in another order, before it has them as a passage.
    second = prose(rng, 60)
    rows += [(20, " ".join([*second[40:], *prose(rng, 60), *second[20:40], *prose(rng, 60), *second[:20], *prose(rng, 60), *second])), (21, " ".join([*prose(rng, 9), *second]))]
    got = {tuple(r)[:-1]: r["identity"] for r in chaining.passages(documents(rows)).collect()}
    assert got == {(11, 33, 123, 10, 20, 110, 90): 1.0, (21, 9, 69, 20, 240, 300, 60): 1.0}


def test_every_exact_copy_is_covered(documents):
    rng = np.random.default_rng(13)
    lines = [[f"v{x}" for x in rng.integers(0, 300, n)] for n in rng.integers(8, 40, 40)]
    texts = [sum((lines[j] for j in rng.integers(0, 40, 8)), []) for _ in range(60)]
    covered = {i: set() for i in range(60)}
    for r in chaining.passages(documents([(i, " ".join(x)) for i, x in enumerate(texts)])).collect():
        covered[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    seen, copies = set(), 0
    for i, text in enumerate(texts):
        runs = [tuple(text[k : k + 50]) for k in range(len(text) - 49)]
        for k, run in enumerate(runs):
            if run in seen:
                copies += 1
                assert covered[i] >= set(range(k, k + 50))
        seen.update(runs)
    assert copies > 20


def test_empty_table(documents):
    assert chaining.passages(documents([])).count() == 0
    assert chaining.without_repeats(documents([])).count() == 0


def test_chain_is_the_best_of_all(rng=np.random.default_rng(8)):
    for _ in range(60):
        n = int(rng.integers(1, 9))
        xs = sorted(rng.integers(0, 30, n).tolist())
        ys = rng.integers(0, 30, n).tolist()
        best = 0.0
        for mask in range(1, 1 << n):
            links = [i for i in range(n) if mask >> i & 1]
            if all(xs[a] < xs[b] and ys[a] < ys[b] for a, b in zip(links, links[1:], strict=False)):
                cost = sum(xs[b] - xs[a] + ys[b] - ys[a] for a, b in zip(links, links[1:], strict=False))
                best = max(best, chaining.KMER * len(links) - chaining.GAP_COST * cost)
        first = next(chaining.chain(xs, ys))
        cost = sum(xs[b] - xs[a] + ys[b] - ys[a] for a, b in zip(first, first[1:], strict=False))
        assert abs(chaining.KMER * len(first) - chaining.GAP_COST * cost - best) < 1e-9


def test_removed_words():
    text = " one two\nthree  four "
    assert chaining.remove(text, [(1, 2), (1, 3)]) == " one four "
    assert chaining.remove(text, [(3, 4)]) == " one two\nthree   "
    assert chaining.remove(text, [(0, 4)]) == ""
    assert re.findall(WORD, chaining.remove(text, [(0, 1), (2, 3)])) == ["two", "four"]


def test_requests_joined_by_shuffle_find_the_same(documents):
    words = prose(np.random.default_rng(12), 400)
    rows = [(i, " ".join([f"own{i}_{k}" for k in range(30)] + words[i * 7 : i * 7 + 120] + [f"end{i}_{k}" for k in range(20)])) for i in range(12)]
    docs = documents(rows)
    want = sorted(map(tuple, chaining.passages(docs).collect()))
    assert want and sorted(map(tuple, chaining.passages(docs, broadcast_bytes=0).collect())) == want
    kept = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    assert kept(chaining.without_repeats(docs, broadcast_bytes=0)) == kept(chaining.without_repeats(docs))


def test_only_runs_that_may_stand_in_smaller_documents_ask(spark):
    at = range(0, 150, 10)
    shared = [(1, p, 1, p) for p in at] + [(2, p, 1, p) for p in at] + [(3, p, 3 if p == 70 else 1, p) for p in at]
    found = spark.createDataFrame([], "doc_id bigint, start_word int, end_word int")
    got = {r["doc_id"]: r for r in chaining.open_runs(spark.createDataFrame(shared, "doc bigint, pos int, other bigint, other_pos int"), found).collect()}
    assert all((r["from"], r["to"]) == ([0], [112]) for r in got.values()) and len(got) == 3
    assert {k: (r["open_from"], r["open_to"]) for k, r in got.items()} == {1: ([], []), 2: ([0], [112]), 3: ([0, 56], [41, 112])}


def test_fuzzy_passage_whose_seeds_stand_elsewhere_first(documents):
    rng = np.random.default_rng(21)
    passage = prose(rng, 96)
    changed = list(passage)
    for at in range(15, 96, 16):
        changed[at] = "changed"
    # Each piece between the changes stands in a smaller document, alone.
    rows = [(k, " ".join([*prose(rng, 40), *passage[16 * k : 16 * k + 15], *prose(rng, 40)])) for k in range(6)]
    rows += [(10, " ".join([*prose(rng, 20), *passage, *prose(rng, 25)])), (11, " ".join([*prose(rng, 33), *changed, *prose(rng, 5)]))]
    got = [tuple(r) for r in chaining.passages(documents(rows)).collect()]
    assert [(r[0], r[3]) for r in got] == [(11, 10)]
    assert got[0][1] >= 33 and got[0][2] <= 33 + 96 and got[0][6] >= 80 and got[0][7] > 0.9
