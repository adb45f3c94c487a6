import random

from lexforge.operators import evaluation as E
from lexforge.plans import catalogue


def test_scores_need_no_exchange_or_join(spark):
    a = spark.createDataFrame([("1", "m", "a b", "a b")], "id string, method string, reference string, prediction string")
    plan = E.score_cases(a, "method")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Generate" not in plan


def test_kept_columns_and_more_cases_than_a_slice(spark):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice("abc") for _ in range(rng.randint(0, 6)))
    rows = [(str(i), f"m{i % 3}", text(), text()) for i in range(700)]
    a = spark.createDataFrame(rows, "id string, method string, reference string, prediction string").coalesce(1)
    got = {r["id"]: r for r in E.score_cases(a, "method").collect()}
    assert len(got) == len(rows)
    for i, method, reference, prediction in rows:
        r = got[i]
        status = "empty_prediction" if not prediction else "empty_reference" if not reference else "scored"
        assert (r["method"], r["status"], r["meteor"] is None) == (method, status, status != "scored")
        if status == "scored":
            n, m = len(reference.split()), len(prediction.split())
            lcs = E.lcs_length(reference.split(), prediction.split())
            assert abs(r["rouge_l"] - 2 * lcs / (n + m)) < 1e-12 and (r["meteor"] > 0) == bool(set(reference) & set(prediction) - {" "})


def test_report_packs_the_evidence_of_its_cases_only(spark, small):
    pairs = catalogue._pairs(spark, small)
    packed = catalogue._packed(spark, small, pairs)
    assert packed.join(pairs, "id", "left_anti").count() == 0
    whole = catalogue._packed(spark, small).join(pairs.select("id"), "id", "left_semi")
    key = lambda df: sorted(map(str, df.select("id", "chunk_id", "rank", "block").collect()))
    assert key(packed) == key(whole) and key(packed)
