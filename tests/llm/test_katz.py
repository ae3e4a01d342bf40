import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import katz


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))


def discounts(counts, k=5):
    n = Counter(counts)
    out = {r: (r - 0.5) / r for r in range(1, k + 1)}
    if n[1]:
        common = (k + 1) * n[k + 1] / n[1]
        for r in range(1, k + 1):
            if n[r] and common != 1:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
                if 0 < d < 1:
                    out[r] = d
    return lambda c: out.get(c, 1.0)


def brute(rows, share):
    """Scores by dictionaries, and the probabilities after each history."""
    texts = [(i, 0 if i is None else zlib.crc32(str(i).encode()) % 10, [*words(t), None]) for i, t in rows]
    single = Counter(w for _, m, ts in texts if m for w in ts)
    total, distinct = sum(single.values()), len(single)
    d1 = discounts(single.values())
    kept = sum(c * d1(c) for c in single.values())
    whole = total if kept < total - 1e-9 else total + 1
    unseen = 1 - kept / whole
    p1 = lambda w: single[w] * d1(single[w]) / whole if single[w] else unseen
    own = {w for w, c in single.items() if c >= max(1, total * share)} | {None}
    of = lambda w: w if w in own else "<rare>"
    share1 = {w: p1(w) for w in own}
    share1["<rare>"] = 1 - sum(share1.values())
    double = Counter()
    for _, m, ts in texts:
        if m:
            double.update(zip(["<s>", *map(of, ts[:-1])], map(of, ts), strict=True))
    d2 = discounts(double.values())
    after = defaultdict(dict)
    for (h, w), c in double.items():
        after[h][w] = c

    def p(h, w):
        seen = after.get(h)
        if not seen:
            return share1[w]
        t, k = sum(seen.values()), sum(c * d2(c) for c in seen.values())
        t = t + 1 if k >= t - 1e-12 else t
        free = 1 - sum(share1[x] for x in seen)
        if free < 1e-9:
            t = k
        if w in seen:
            return d2(seen[w]) * seen[w] / t
        return 0.0 if free < 1e-9 else (1 - k / t) / free * share1[w]

    out = []
    for i, m, ts in texts:
        base = sum(math.log10((single[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ts)
        classes = list(map(of, ts))
        score = sum(math.log10(p(h, c)) + (math.log10(p1(w) / share1["<rare>"]) if c == "<rare>" else 0) for h, c, w in zip(["<s>", *classes[:-1]], classes, ts, strict=True))
        out.append((i if i is not None else -1, m == 0, len(ts), sum(w in single for w in ts), total, round(base, 6), round(score, 6)))
    return sorted(out), p, share1, set(after)


def rows_of(df):
    return sorted((-1 if r[0] is None else r[0], *r[1:5], round(r[5], 6), round(r[6], 6)) for r in df.collect())


@pytest.mark.parametrize("share", [0.02, 0.0005])
def test_scores_equal_brute_force_and_sum_to_one(documents, odd, share):
    rng = np.random.default_rng(5)
    lexicon = np.array([f"W{i}" for i in range(300)])
    weights = 1 / np.arange(1, 301)
    rows = odd + [(100 + i, " ".join(rng.choice(lexicon, 40, p=weights / weights.sum()))) for i in range(60)]
    want, p, share1, histories = brute(rows, share)
    assert rows_of(katz.score(documents(rows), share)) == want
    for h in list(histories)[:40]:
        assert abs(sum(p(h, w) for w in share1) - 1) < 1e-9


def test_empty_table_and_no_training_documents(documents):
    assert katz.score(documents([])).count() == 0
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = katz.score(documents([(held, "only held out words")])).collect()
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"]) == (True, 5, 0, 0)
    assert row["base_score"] == 0 and math.isfinite(row["score"])


def test_pairs_of_rare_words_count_as_they_are(documents):
    rng = np.random.default_rng(6)
    lexicon = np.array([f"W{i}" for i in range(2000)])
    weights = 1 / np.arange(1, 2001)
    rows = [(100 + i, " ".join(rng.choice(lexicon, 50, p=weights / weights.sum()))) for i in range(80)]
    # Words far below the share that is kept in every task, always in this order.
    rows += [(1000 + i, "seldom heard of words " + " ".join(rng.choice(lexicon, 20, p=weights / weights.sum()))) for i in range(4)]
    rows += [(2000 + i, "seldom heard of others " + " ".join(f"new{i}x{j}" for j in range(5)) + " words W0 seldom") for i in range(30)]
    want, *_ = brute(rows, 0)
    assert rows_of(katz.score(documents(rows), cache=0.02)) == want
    assert rows_of(katz.score(documents(rows))) == want


def test_rare_pairs_in_many_parts(documents, monkeypatch):
    monkeypatch.setattr(katz, "BYTES_PER_PART", 500)
    monkeypatch.setattr(katz, "_HELD_KEYS", 100)
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"w{j}" for j in rng.zipf(1.3, 30) % 997)) for i in range(150)]
    assert rows_of(katz.score(documents(rows), cache=0.01)) == brute(rows, 0)[0]
