import json
import random

import pytest
from pyspark.sql import functions as F

from lexforge import runtime, schemas
from lexforge.operators import audit, prompting
from lexforge.plans import catalogue


def test_latest_counts_redeliveries_once(spark, rows):
    df = spark.createDataFrame([("a", "x", "2031-01-01"), ("a", "y", "2031-01-02"), ("b", None, None), ("b", None, None)], "id string, v string, received_at string")
    assert rows(runtime.latest(df, ["id"])) == [("a", "y", "2031-01-02"), ("b", None, None)]
    assert runtime.latest(df.limit(0), ["id"]).count() == 0


def test_length_statistics(spark):
    df = spark.createDataFrame([(n,) for n in range(1, 21)], "n int")
    s = audit.length_stats(df, F.col("n")).first()
    assert (s["min"], s["max"], s["p50"], round(s["p90"], 6), round(s["p95"], 6)) == (1, 20, 10.5, 18.1, 19.05)
    assert audit.length_summary(df, F.col("n")).first()["p95"] == 19


def test_contains_and_fit(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(audit.contains_normal(F.lit("Điều  MỘT"), F.lit("điều một"))) and not one(audit.contains_text(F.lit("x"), F.lit(" ")))
    assert one(audit.token_overlap(F.lit("a a b"), F.lit("b c"))) == 0.5
    fit = lambda q, a, p, n: one(audit.fit_status(F.lit(q), F.lit(a), F.lit(p), n))
    assert [fit("q", None, "p", 99), fit("q", "a", None, 99), fit("q", "a", "p", 20), fit("q", "a", "p " * 40, 40), fit("q", "a", "p", 40)] == [
        "no_target", "no_evidence", "TARGET_DOES_NOT_FIT", "evidence_truncated_needed", "fits",
    ]


def test_holders_find_every_needle(spark, rows, monkeypatch):
    rng = random.Random(3)
    word = lambda least, most: "".join(rng.choice("abđ𝒳 ") for _ in range(rng.randint(least, most)))
    needles = list({*(word(1, 7) for _ in range(30)), "Có.", "-", " ", None, "\xa0", "", "đ" * 64, "đ" * 130})
    texts = [(f"t{i}", word(0, 60), [word(0, 4), None]) for i in range(40)] + [("long", "x" + "đ" * 129, ["a-1"]), ("yes", "Có.", []), ("null", None, None)]
    given = [n for n in needles if n and n.strip()]
    expected = sorted((i, a, b) for i, t, f in texts if (a := sum(n in (t or "") for n in given)) + (b := sum(any(n in x for x in f or () if x) for n in given)))
    n, t = spark.createDataFrame([(x,) for x in needles], "needle string"), spark.createDataFrame(texts, "text_id string, text string, fields array<string>")
    for size in (audit.HOLDER_BYTES, 64):  # one block and several
        monkeypatch.setattr(audit, "HOLDER_BYTES", size)
        assert rows(audit.holders(n, t)) == expected
    assert audit.holders(n.limit(0), t).count() == 0 and audit.holders(n, t.limit(0)).count() == 0


def test_gold_leaks_have_short_and_train_answers(spark, tmp_path):
    spark.createDataFrame([("1", "q", "Có.", "train", "s", "2031-01-01"), ("2", "q", "5 giờ", "public", "s", "2031-01-01")], "id string, question string, answer string, split string, source string, received_at string").write.parquet(f"{tmp_path}/legal_questions.parquet")
    chunks = [("c1", "trả lời: Có."), ("c2", "sau 5 giờ"), ("c3", "không")]
    spark.createDataFrame([(c, "d", "p", None, None, t, t) for c, t in chunks], "chunk_id string, document_id string, source_path string, source_member string, section_label string, raw_text string, retrieval_text string").write.parquet(f"{tmp_path}/legal_chunks.parquet")
    assert {tuple(r) for r in catalogue.gold_leaks(spark, str(tmp_path)).collect()} == {("c1", 1, 0), ("c2", 1, 0)}


def test_case_support(spark):
    rows = [("1", "b c", "a\nb c", "a", "a\nb c"), ("2", "B  c", "a b c", "a b c", "a b c"), ("3", "", "a", "a", "a"), ("4", "a", "", "", ""), ("5", " ", "a b", "a", "a"), ("6", "a x", "a", "a", "a")]
    got = {r["id"]: r for r in audit.case_support(spark.createDataFrame(rows, "id string, answer string, evidence string, top1 string, top3 string")).collect()}
    assert [got["1"][c] for c in ("exact", "top1_exact", "top3_exact", "overlap")] == [True, False, True, 1.0]
    assert [got["2"][c] for c in ("exact", "normal", "top1_normal")] == [False, True, True]
    assert set(got["3"][1:]) == {None} and got["4"]["exact"] is False and got["4"]["overlap"] is None
    assert got["5"]["exact"] is False and got["5"]["overlap"] == 0.0 and got["6"]["overlap"] == 0.5


def test_evidence_support_is_of_the_packed_evidence(spark, tmp_path):
    chunks = [(f"c{i}", f"d{i}", "p", None, None, t, t) for i, t in enumerate(["một hai", "ba bốn", "năm sáu", "bảy tám"])]
    path = str(tmp_path)
    spark.createDataFrame([("1", "q", "bảy tám", "train", "s", "2031"), ("2", "q", "năm", "train", "s", "2031")], "id string, question string, answer string, split string, source string, received_at string").write.parquet(f"{path}/legal_questions.parquet")
    spark.createDataFrame(chunks, "chunk_id string, document_id string, source_path string, source_member string, section_label string, raw_text string, retrieval_text string").write.parquet(f"{path}/legal_chunks.parquet")
    spark.createDataFrame([(f"d{i}", "n", "x", "p", None, "h", "l", "2031", None) for i in range(4)], "id string, name string, passage string, source_path string, source_member string, content_hash string, link string, received_at string, created_at string").write.parquet(f"{path}/legal_documents.parquet")
    hits = [(q, "m", f"c{i}", f"d{i}", "p", i + 1, 1.0, None, "2031", None) for q in "12" for i in range(4)]
    spark.createDataFrame(hits, "id string, method string, chunk_id string, document_id string, source_path string, rank int, bm25_score double, rerank_score double, received_at string, created_at string").write.parquet(f"{path}/retrieval_hits.parquet")
    got = {r["id"]: (r["exact"], r["top1_exact"], r["top3_exact"], r["overlap"]) for r in catalogue.evidence_support(spark, path).collect()}
    assert got == {"1|m": (True, False, False, 1.0), "2|m": (True, False, True, 1.0)}
    assert {(r["id"], r["rank"]) for r in catalogue.answer_support(spark, path).collect() if r["exact"]} == {("1|m", 4), ("2|m", 3)}


def test_schema_rules(spark, rows):
    c = spark.createDataFrame([("c", "d", " ", "t", 5, 5), (None, "d", "r", "t", 1, None)], "chunk_id string, document_id string, raw_text string, retrieval_text string, start_offset int, end_offset int")
    assert rows(schemas.violations(c, "document_id", schemas.chunk_rules())) == [("d", "chunk_id_blank"), ("d", "offsets_not_ascending"), ("d", "one_offset_missing"), ("d", "raw_text_blank")]
    with pytest.raises(ValueError, match="unknown columns"):
        schemas.conform(c, schemas.QUESTION)


def test_prompts_replace_question_first(spark):
    t = prompting.Template("t", "1", "Q {question} E {evidence}")
    assert spark.range(1).select(prompting.render(t, F.lit("a{evidence}"), F.lit("X"))).first()[0] == "Q aX E X"
    with pytest.raises(ValueError):
        prompting.render(t, F.lit("a"))


def test_mock_generation(spark):
    p = spark.createDataFrame([("1", "x"), ("2", " ")], "id string, prompt string")
    got = {r["id"]: (r["raw_answer"], r["error_code"]) for r in prompting.mock_generate(p).collect()}
    assert got["1"][0].startswith("Mock response [") and got["2"] == (None, "EMPTY_PROMPT")


def test_chat_client_retries_and_codes(spark):
    calls = []

    def transport(url, body, headers, timeout):
        calls.append(json.loads(body))
        if len(calls) < 3:
            raise TimeoutError
        return json.dumps({"choices": [{"message": {"content": "ok"}}]}).encode()

    waits = []
    client = prompting.ChatClient("http://x", "m", "k", transport=transport, sleep=waits.append)
    assert client("hi") == ("ok", 2) and waits == [0.5, 1.0]
    with pytest.raises(prompting.ProviderError) as e:
        prompting.ChatClient("http://x", "m", transport=lambda *a: b"{}")("hi")
    assert e.value.code == "LLM_INVALID_RESPONSE"
    assert prompting.redact("Bearer abc, api_key=xyz") == "Bearer <redacted>, api_key=<redacted>"
    p = spark.createDataFrame([("1", "x"), ("2", "")], "id string, prompt string")
    got = {r["id"]: (r["status"], r["error_code"]) for r in prompting.generate(p, lambda: prompting.ChatClient("http://x", "m", transport=lambda *a: b'{"choices":[{"message":{"content":"ok"}}]}')).collect()}
    assert got == {"1": ("success", None), "2": ("error", "EMPTY_PROMPT")}
