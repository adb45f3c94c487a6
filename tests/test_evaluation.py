import random

import pytest

from lexforge.operators import evaluation as E


def meteor(reference, prediction):
    used, matched = set(), []
    for t in prediction:
        j = next((j for j, r in enumerate(reference) if r == t and j not in used), None)
        if j is not None:
            used.add(j)
            matched.append(j)
    m = len(matched)
    p, r = m / len(prediction) if prediction else 0, m / len(reference) if reference else 0
    f = 10 * p * r / (r + 9 * p) if r + 9 * p else 0
    chunks = sum(1 for i, j in enumerate(matched) if i == 0 or j != matched[i - 1] + 1)
    return m, chunks, f * (1 - (0.5 * (chunks / m) ** 3 if chunks > 1 else 0))


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_metrics_match_brute_force(spark):
    rng = random.Random(3)
    cases = [(str(i), [rng.choice("abcde") for _ in range(rng.randint(0, 14))], [rng.choice("abcde") for _ in range(rng.randint(0, 14))]) for i in range(150)]
    df = spark.createDataFrame(cases, "id string, reference_tokens array<string>, prediction_tokens array<string>")
    got = {r["id"]: r for r in E.meteor(df).collect()}
    rouge = {r["id"]: r for r in E.rouge_l(df).collect()}
    for i, ref, pred in cases:
        m, c, s = meteor(ref, pred)
        assert (got[i]["matches"], got[i]["chunks"]) == (m, c) and abs(got[i]["meteor"] - s) < 1e-12
        assert rouge[i]["lcs"] == lcs(ref, pred)
        assert abs(rouge[i]["rouge_l"] - (2 * lcs(ref, pred) / (len(ref) + len(pred)) if lcs(ref, pred) else 0)) < 1e-12


def test_score_cases_status(spark):
    a = spark.createDataFrame([("1", "a b", "a b"), ("2", "a", "  "), ("3", "", "x"), ("4", None, None)], "id string, reference string, prediction string")
    got = {r["id"]: (r["status"], r["meteor"], r["rouge_l"]) for r in E.score_cases(a).collect()}
    assert got == {"1": ("scored", 1.0, 1.0), "2": ("empty_prediction", None, None), "3": ("empty_reference", None, None), "4": ("empty_prediction", None, None)}
    m = E.macro(E.score_cases(a)).first()
    assert (m["n_cases"], m["n_scored"], m["n_empty_prediction"], m["n_empty_reference"]) == (4, 1, 2, 1)


def test_alignment(spark):
    r = spark.createDataFrame([("1", "a"), ("2", "b"), ("2", "b")], "id string, answer string")
    p = spark.createDataFrame([("1", "a"), ("3", "c")], "id string, answer string")
    assert sorted(map(tuple, E.alignment_issues(r, p).collect())) == [("2", "duplicate"), ("2", "missing"), ("3", "extra")]
    with pytest.raises(Exception, match="do not align"):
        E.align(r, p).collect()
    assert E.align(r.limit(1), p.limit(1)).count() == 1


def test_exact_match_and_f1(spark):
    a = spark.createDataFrame([("1", "A b, b", "a B b"), ("2", "x y", "y z z"), ("3", "", None), ("4", "x", "")], "id string, reference string, prediction string")
    got = {r["id"]: (r["exact_match"], round(r["token_f1"], 6)) for r in E.exact_match_f1(a).collect()}
    assert got == {"1": (1.0, 1.0), "2": (0.0, 0.4), "3": (1.0, 1.0), "4": (0.0, 0.0)}


def test_error_report_is_worst_first(spark):
    s = spark.createDataFrame([("a", "scored", 0.8, 0.9), ("b", "scored", 0.1, 0.2), ("c", "empty_prediction", None, None)], "id string, status string, meteor double, rouge_l double")
    refs = spark.createDataFrame([("a", "x|y"), ("b", "u\nv"), ("c", "w")], "id string, answer string")
    block = "struct<rank int, chunk_id string, document_id string, block string>"
    packed = spark.createDataFrame([("a", "success", [(1, "k", "d", "t" * 300)]), ("b", "success", [])], f"id string, status string, blocks array<{block}>")
    types = spark.createDataFrame([("a", "OTHER")], "id string, error_type string")
    report = E.error_report(s, refs, refs, E.retrieval_status(packed), types)
    assert [(r["id"], r["retrieval_status"]) for r in report.orderBy("place").collect()] == [("c", "not_available"), ("b", "miss"), ("a", "success")]
    lines = [r["line"] for r in E.markdown_lines(report, {}).orderBy("line_no").collect()][-2:]
    assert "u<br>v" in lines[0] and "x\\|y" in lines[1] and "0.800000" in lines[1]
    with pytest.raises(Exception, match="unknown error type"):
        E.error_report(s, refs, refs, E.retrieval_status(packed), spark.createDataFrame([("a", "NOPE")], "id string, error_type string")).collect()


def test_error_report_ties_scores_that_differ_in_their_last_bits(spark):
    s = spark.createDataFrame([("a", "scored", 0.1 + 0.2, 0.2), ("b", "scored", 0.3, 0.9), ("c", "scored", 0.3, 0.1 + 0.1)], "id string, status string, meteor double, rouge_l double")
    texts = spark.createDataFrame([(i, "x") for i in "abc"], "id string, answer string")
    packed = spark.createDataFrame([], "id string, status string, blocks array<struct<rank int, chunk_id string, document_id string, block string>>")
    report = E.error_report(s, texts, texts, E.retrieval_status(packed))
    assert [r["id"] for r in report.orderBy("place").collect()] == ["a", "c", "b"]
