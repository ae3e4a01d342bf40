"""The two classifiers: accuracy on rows held out, and odd inputs."""

import random
import zlib

import numpy as np
import pytest

from tidemark.llm import classifier, toxicity


@pytest.fixture(scope="module")
def lexicon():
    rng = random.Random(4)
    return ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(2, 8))) for _ in range(2000)]


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def test_quality_of_held_out_rows(spark, documents, lexicon, odd):
    rng = random.Random(1)
    rows, good = list(odd), {}
    for i in range(1000, 1700):
        words = [rng.choice(lexicon) for _ in range(rng.randint(30, 90))]
        good[i] = int(i % 3 > 0)
        rows.append((i, " ".join(words if good[i] else [w.upper() + "!!" if i % 2 else w + "&&&" for w in words])))
    labels = spark.createDataFrame([*good.items(), (1, None), (None, 1), (8, 0), (8, 1), (99999, 1)], "doc_id bigint, label int")
    got = classifier.classify(documents(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is None or fold(r["doc_id"]) == 0) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in good]
    assert np.mean([r["predicted"] == good[r["doc_id"]] for r in held]) > 0.93
    twins = [r["score"] for r in got if r["doc_id"] == 8]
    assert twins[0] == twins[1]


def test_labels_are_read_from_other_folds_only(spark, documents, lexicon):
    rows = [(i, " ".join(random.Random(i).choices(lexicon, k=30))) for i in range(200)]
    scores = []
    for flip in (0, 1):
        labels = spark.createDataFrame([(i, (i % 2) ^ (flip if fold(i) == 0 else 0)) for i in range(200)], "doc_id bigint, label int")
        scores.append(sorted((r["doc_id"], r["score"]) for r in classifier.classify(documents(rows), labels).collect()))
    assert scores[0] == scores[1]


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] + rng.normal(0, 1.5, 600) > 0).astype(float)
    network = classifier.Network(x[:60], y[:60])
    loss = lambda: -np.log(np.where(y[300:] > 0, network.score(x[300:]), 1 - network.score(x[300:])) + 1e-12).mean()
    before = loss()
    network.calibrate(x[60:300], y[60:300])
    assert network.temperature != 1.0 and loss() < before


def test_severity_of_held_out_rows(spark, documents, lexicon, odd):
    rng = random.Random(2)
    slurs = ["dolt", "oafish", "wretch", "vermin"]
    rows, toxic, number = list(odd), {}, {}
    for i in range(2000, 2800):
        words = [rng.choice(lexicon) for _ in range(rng.randint(30, 150))]
        number[i] = 0 if i % 4 else rng.randint(1, 4)
        for w in rng.sample(slurs, number[i]):
            words.insert(rng.randrange(len(words)), w.upper() if i % 8 else w + ",")
        toxic[i] = int(number[i] > 0)
        rows.append((i, " ".join(words)))
    labels = spark.createDataFrame([*toxic.items(), (2, None), (None, 1), (77777, 1)], "doc_id bigint, label int")
    got = toxicity.grade(documents(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["severity"] <= toxicity.GRADES and r["toxic"] == (r["p_toxic"] >= 0.5) for r in got)
    held = [r for r in got if r["doc_id"] in toxic and fold(r["doc_id"]) == 0]
    assert np.mean([r["toxic"] == bool(toxic[r["doc_id"]]) for r in held]) > 0.95
    mean = lambda n: np.mean([r["severity"] for r in held if number[r["doc_id"]] == n])
    assert mean(0) < mean(1) < mean(2) < mean(4)


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(1, 0)]])
def test_without_two_classes(spark, documents, labels):
    given = spark.createDataFrame(labels, "doc_id bigint, label int")
    docs = documents([(1, "some text"), (2, None), (3, "")])
    assert {r["score"] for r in classifier.classify(docs, given).collect()} == {0.5}
    assert not any(r["toxic"] for r in toxicity.grade(docs, given).collect())
    assert classifier.classify(documents([]), given).count() == 0
    assert toxicity.grade(documents([]), given).count() == 0


def test_ordinal_probabilities_are_ordered():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 4, 300)
    rows = [np.array([k for k in range(4) if k <= g] + [10 + int(rng.integers(20))]).reshape(-1, 1) for g in y]
    model = toxicity.Ordinal(rows, y)
    assert (np.diff(model.thresholds) > 0).all() and (model.weights > 0).all()
    above = model.above(np.linspace(-5, 20, 50))
    assert (np.diff(above, axis=1) <= 0).all() and (np.diff(above, axis=0) >= 0).all()
