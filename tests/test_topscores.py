import random

import numpy as np
import pytest

from lexforge.operators import index, retrieval, topscores

from tests.test_retrieval import brute


@pytest.fixture
def tiny_blocks(spark, monkeypatch):
    """Many blocks of texts and of queries."""
    monkeypatch.setattr(topscores, "BLOCK_TEXTS", 20)
    monkeypatch.setattr(topscores, "QUERY_BYTES", 150)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "15")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def corpus(n, seed=5):
    rng = random.Random(seed)
    words = [f"t{i}" for i in range(60)]
    text = lambda: " ".join(words[min(59, int(rng.expovariate(0.12)))] for _ in range(rng.randint(0, 25)))
    texts = [text() for _ in range(n // 2)]
    return [(f"c{i:04d}", rng.choice(texts)) for i in range(n)], [(f"q{i}", text()) for i in range(12)]


def test_no_row_per_question_term_and_chunk(spark):
    chunks = spark.createDataFrame([("a", "thuế neo")], "chunk_id string, retrieval_text string")
    questions = spark.createDataFrame([("1", "thuế")], "id string, question string")
    plan = retrieval.bm25(questions, index.build(chunks))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_bm25_over_blocks_equals_the_loop(spark, tiny_blocks, tmp_path):
    chunks, questions = corpus(160)
    built = index.build(spark.createDataFrame(chunks, "chunk_id string, retrieval_text string").repartition(3))
    index.store(built, str(tmp_path), a=1)
    asked = spark.createDataFrame(questions, "id string, question string")
    for some in (built, index.load(spark, str(tmp_path), a=1)[0]):
        got = {}
        for r in retrieval.bm25(asked, some, 12).orderBy("id", "rank").collect():
            got.setdefault(r["id"], []).append((r["chunk_id"], r["bm25_score"]))
        for i, q in questions:
            expected = brute(q, chunks)[:12]
            assert [c for c, _ in got.get(i, [])] == [c for c, _ in expected]
            assert all(abs(s - e) < 1e-8 for (_, s), (_, e) in zip(got.get(i, []), expected))


def test_terms_left_for_last_lose_no_text():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n, v = 3000, 12
        parts = [np.flatnonzero(rng.random(n) < p).astype(np.int32) for p in rng.choice([0.001, 0.01, 0.2, 0.7], v)]
        at = np.cumsum([0, *map(len, parts)])
        docs = np.concatenate(parts)
        w = np.round(rng.random(len(docs)), 1) * np.repeat(rng.choice([0.5, 3.0, 8.0], v), np.diff(at))
        most = np.array([w[a:z].max() if z > a else 0.0 for a, z in zip(at, at[1:])])
        terms, times = np.arange(v), rng.choice([1.0, 2.0], v)
        whole = np.round(np.bincount(docs, weights=w * np.repeat(times, np.diff(at)), minlength=n), 9)
        order = [d for d in np.lexsort((np.arange(n), -whole)) if whole[d] > 0][:10]
        got, score = topscores._best_of(terms, times, at, docs, w, most, n, 0.0, 10)
        assert got.tolist() == order and np.array_equal(score, whole[order])
        got, _ = topscores._best_of(terms, times, at, docs, w, most, n, float(whole[order[4]]), 10)
        assert got[:5].tolist() == order[:5]
