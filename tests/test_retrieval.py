import math
from collections import Counter

from pyspark.sql import functions as F

from lexforge.operators import index, rerank, retrieval

CHUNKS = [("z", "thuế bãi thuế"), ("a", "thuế neo"), ("b", "thuế neo"), ("c", "kho lạnh"), ("e", "")]


def brute(question, chunks, k1=1.5, b=0.75):
    docs = {c: Counter(t.split()) for c, t in chunks}
    lengths = {c: len(t.split()) for c, t in chunks}
    average = sum(lengths.values()) / len(docs)
    out = {}
    for c, tf in docs.items():
        s = 0.0
        for w in set(question.split()):
            if tf[w]:
                df = sum(w in d for d in docs.values())
                s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * lengths[c] / average))
        if s > 0:
            out[c] = s
    return sorted(out.items(), key=lambda x: (-round(x[1], 9), x[0]))


def test_bm25_matches_the_loop_and_breaks_ties_by_id(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, retrieval_text string")
    questions = spark.createDataFrame([("1", "thuế neo neo"), ("2", "không có"), ("3", None)], "id string, question string")
    got = retrieval.bm25(questions, index.build(chunks), 10).orderBy("id", "rank").collect()
    expected = brute("thuế neo neo", CHUNKS)
    assert [(r["chunk_id"], r["rank"]) for r in got] == [(c, n + 1) for n, (c, _) in enumerate(expected)]
    assert all(abs(r["bm25_score"] - s) < 1e-8 for r, (_, s) in zip(got, expected))
    assert {r["id"] for r in got} == {"1"}


def test_empty_index(spark):
    chunks = spark.createDataFrame([], "chunk_id string, retrieval_text string")
    questions = spark.createDataFrame([("1", "thuế")], "id string, question string")
    assert retrieval.bm25(questions, index.build(chunks)).count() == 0
    assert index.build(chunks).stats.first()["n_docs"] == 0


def test_reader_bm25_fills_with_zero_scores_in_source_order(spark):
    cases = spark.createDataFrame([("c1", 1, "kho"), ("c2", 2, "Thuế thuế"), ("c3", 3, "neo")], "case_id string, pos int, context string")
    q = spark.createDataFrame([("q", "THUẾ")], "id string, question string")
    got = retrieval.reader_bm25(q, cases, 3).orderBy("rank").collect()
    assert [r["case_id"] for r in got] == ["c2", "c1", "c3"] and got[1]["score"] == 0


def test_index_store_and_load(spark, tmp_path):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, retrieval_text string")
    assert index.load(spark, str(tmp_path), a=1) == (None, "index_missing")
    index.store(index.build(chunks), str(tmp_path), a=1)
    loaded, status = index.load(spark, str(tmp_path), a=1)
    assert status == "hit" and loaded.postings.count() == index.build(chunks).postings.count()
    assert index.load(spark, str(tmp_path), a=2)[1] == "index_missing"


def hits(spark):
    return spark.createDataFrame([("q", "a", 1, 3.0), ("q", "b", 2, 2.0), ("q", "c", 3, 1.0)], "id string, chunk_id string, rank int, bm25_score double")


def test_rerankers(spark):
    assert [r["chunk_id"] for r in rerank.mock(hits(spark)).orderBy("rank").collect()] == ["a", "b", "c"]
    scores = spark.createDataFrame([("c", 9.0), ("b", 0.5)], "chunk_id string, score double")
    assert [r["chunk_id"] for r in rerank.mock(hits(spark), scores).orderBy("rank").collect()] == ["c", "a", "b"]
    q = spark.createDataFrame([("q", [1.0, 0.0])], "id string, vector array<double>")
    c = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [0.8, 0.6])], "chunk_id string, vector array<double>")
    got = rerank.by_vectors(hits(spark), q, c).orderBy("rank").collect()
    assert [(r["chunk_id"], r["rerank_score"], r["used"]) for r in got] == [("b", 0.8, True), ("a", 0.0, True), ("c", None, False)]
    encode = lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]
    chunks = spark.createDataFrame([("a", "x"), ("b", "xx"), ("c", "xxx")], "chunk_id string, retrieval_text string")
    questions = spark.createDataFrame([("q", "xxx")], "id string, question string")
    assert rerank.semantic(hits(spark), questions, chunks, encode).orderBy("rank").first()["chunk_id"] == "c"
    assert rerank.status(rerank.noop(hits(spark))).first()["used"] == "false"


def test_nearest_is_exact(spark):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 3), 1.0]) for i in range(60)], "vec_id long, embedding array<float>")
    got = rerank.nearest(v, v.where("vec_id % 50 = 0"), 3).where("query_id = 50").orderBy("rank").collect()
    rows = {r["vec_id"]: r["embedding"] for r in v.collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    best = sorted(((-round(cos(rows[50], e), 6), i) for i, e in rows.items() if i != 50))[:3]
    assert [r["vec_id"] for r in got] == [i for _, i in best]


def test_candidates_drop_seen_contexts(spark):
    cases = spark.createDataFrame([("q", "own")], "id string, context string")
    found = spark.createDataFrame([("q", "c1", 1), ("q", "c2", 2), ("q", "c3", 3)], "id string, case_id string, rank int")
    contexts = spark.createDataFrame([("c1", "own"), ("c2", "x"), ("c3", "x")], "case_id string, context string")
    got = retrieval.reader_candidates(cases, found, contexts).orderBy("position").collect()
    assert [(r["position"], r["origin"], r["context"]) for r in got] == [(0, "original", "own"), (1, "train_retrieval", "x")]
    spans = spark.createDataFrame([("q", 0, "a", 0.5), ("q", 1, "b", 0.5)], "id string, position int, answer string, confidence double")
    assert retrieval.best_span(spans).first()["answer"] == "a"
    assert F is not None
