from lexforge.operators import reader, retrieval


def cases(spark):
    rows = [("c1", 1, "kho"), ("c2", 2, "Thuế thuế"), ("c3", 3, "neo"), ("c4", 4, "thuế neo"), ("c5", 5, None)]
    return spark.createDataFrame(rows, "case_id string, pos int, context string")


def test_reader_hits_join_no_postings(spark):
    q = spark.createDataFrame([("q", "THUẾ neo")], "id string, question string")
    plan = retrieval.reader_bm25(q, cases(spark), 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan  # words are read once, into blocks


def test_only_questions_with_free_places_are_filled(spark):
    q = spark.createDataFrame([("full", "thuế neo"), ("one", "kho"), ("none", "lạ"), ("null", None)], "id string, question string")
    got = {}
    for r in retrieval.reader_bm25(q, cases(spark), 3).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["case_id"], r["score"] > 0))
    assert {c for c, _ in got["full"]} == {"c2", "c3", "c4"} and all(s for _, s in got["full"])
    assert got["one"] == [("c1", True), ("c2", False), ("c3", False)]
    assert got["none"] == got["null"] == [("c1", False), ("c2", False), ("c3", False)]


def test_candidates_and_best_over_repeated_contexts(spark):
    q = spark.createDataFrame([("q", "thuế neo", "own")], "id string, question string, context string")
    many = spark.createDataFrame([(f"c{i:03d}", f"c{i:03d}", "thuế neo") for i in range(300)], "case_id string, pos string, context string")
    hits = retrieval.reader_bm25(q.select("id", "question"), many, 5).orderBy("rank").collect()
    assert [r["case_id"] for r in hits] == [f"c{i:03d}" for i in range(5)]
    done = reader.run(q, reader.mock(lambda question, context: reader.Span(context, float(len(context)))), "tuned_bm25_reader", many, 5)
    assert [(r["answer"], r["source_case_id"]) for r in done.predictions.collect()] == [("thuế neo", "c000")]
    assert done.candidates.count() == 2


def test_retrieved_contexts_come_once_behind_the_own_one(spark):
    q = spark.createDataFrame([("q", "thuế neo", "thuế")], "id string, question string, context string")
    hits = retrieval.reader_bm25(q.select("id", "question"), cases(spark), 3)
    got = retrieval.reader_candidates(q.select("id", "context"), hits, cases(spark).select("case_id", "context")).orderBy("position").collect()
    assert [(r["position"], r["source_case_id"]) for r in got] == [(0, "q"), (1, "c4"), *[(n + 2, c) for n, c in enumerate(r["case_id"] for r in hits.where("rank > 1").orderBy("rank").collect())]]
