import random

import pytest

import corpus_pipeline
from tests.llm.test_minhash import brute


def write(docs, workdir):
    docs.write.parquet(f"{workdir}/documents.parquet")
    return workdir


def corpus():
    rng = random.Random(11)
    lexicon = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    prose = lambda n: [rng.choice(lexicon) for _ in range(n)]
    rows, passage = [], prose(70)
    for i in range(240):
        words = prose(rng.randint(70, 300))
        if i % 40 == 5:
            words[20:20] = passage
        rows.append((i, " ".join(words), "en", f"src{i % 4}"))
    for i in range(30):  # near copies
        words = rows[i][1].split()
        words[len(words) // 2] = "other"
        rows.append((500 + i, " ".join(words), "en", "src0"))
    rows += [(700 + i, " ".join(w + "***" for w in prose(120)), "en", "src1") for i in range(10)]
    rows += [(800, None, "en", None), (801, "", None, "src1"), (None, " ".join(prose(200)), "en", "src2")]
    return rows


def test_stages_take_effect_one_after_another(spark, documents, workdir):
    sf_dir = write(documents(corpus()), workdir)
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{workdir}/{number}")
        docs = spark.read.parquet(f"{workdir}/{number}")
        seen.append((name, docs.collect()))
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    by = dict(seen)
    kept = {r["doc_id"] for r in by["quality_rules"]}
    assert kept == {*range(240), *range(500, 530), None}
    rows = [(r["doc_id"], r["text"]) for r in by["quality_rules"]]
    assert {r["doc_id"] for r in by["near_dedup"]} == {i for i, _, _, k in brute(rows, 5, 80) if k}
    texts = {r["doc_id"]: r["text"] for r in by["near_dedup"]}
    for r in by["substring_dedup"]:
        assert r["n_chars"] == len(r["text"])
        gone = len(texts[r["doc_id"]].split()) - len(r["text"].split())
        assert 70 <= gone <= 74 if r["doc_id"] is not None and r["doc_id"] % 40 == 5 and r["doc_id"] != 5 else gone == 0
    before, after = ({r["doc_id"]: r for r in by[x]} for x in ("substring_dedup", "mix_sources"))
    assert set(after) <= set(before) and all(after[i]["text"] == before[i]["text"] for i in after)
    words = lambda rows, s: sum(len(r["text"].split()) for r in rows if r["source"] == s)
    total = sum(words(by["substring_dedup"], f"src{i}") for i in range(4))
    for i, weight in enumerate([5, 2, 1, 5]):
        assert words(by["mix_sources"], f"src{i}") == pytest.approx(total * weight / 13, rel=0.2)
    assert {r["doc_id"] for r in by["best_fit_packing"]} == set(after)


def test_run_gives_the_last_stage_and_bears_an_empty_table(spark, documents, workdir):
    sf_dir = write(documents([]), workdir)
    assert corpus_pipeline.run(spark, sf_dir).count() == 0
