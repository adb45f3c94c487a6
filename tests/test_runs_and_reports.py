import json
import urllib.error
import zipfile

import pytest
from pyspark.sql import functions as F

from lexforge import governance as G
from lexforge import runtime
from lexforge.operators import evidence, evaluation, index, prompting, reader, rerank, submission
from lexforge.plans import fewshot, pipeline, reports
from lexforge.sources import cache, files, sinks

DOC = "id string, name string, passage string, source_path string, source_member string, content_hash string, link string"
DIRECT, RAG = prompting.Template("direct", "1", "{question}"), prompting.Template("rag", "1", "{evidence}\n---\n{question}")


def corpus(spark):
    return spark.createDataFrame([("d1", "Luật Đất đai", "Điều 1. Mức phạt\nMức phạt là 5 triệu đồng.", "a/b.json", None, "h", "https://x.example"), ("d2", "Luật khác", "Điều 2. Thuế\nThuế là 10 phần trăm.", "a/c.json", None, "h", None)], DOC)


def asked(spark):
    return spark.createDataFrame([("1", "Mức phạt là bao nhiêu?"), ("2", "zzz")], "id string, question string")


def test_prompts_name_the_document(spark):
    done = pipeline.run(asked(spark), corpus(spark), G.Profile(), RAG)
    prompt = done.prompts.where("id = '1'").first()["prompt"]
    assert prompt == "[TRÍCH ĐOẠN 1]\nVăn bản: Luật Đất đai\nMã tài liệu: d1\nĐiều/Khoản: Điều 1\nNguồn: https://x.example\nNội dung:\nĐiều 1. Mức phạt\nMức phạt là 5 triệu đồng.\n\n" + prompt.split("\n\n", 1)[1]
    assert {r["id"]: r["error_code"] for r in done.predictions.collect()} == {"1": None, "2": "RETRIEVAL_ERROR"}
    record = {r["id"]: r for r in pipeline.retrieval_records(done, asked(spark), G.Profile()).collect()}
    assert record["1"]["packed_evidence"]["included_ids"] and record["2"]["raw_hits"] is None and record["1"]["top_k_limited_ids"] == []
    sent = pipeline.generation_records(done, G.Profile(), RAG).collect()
    assert [(r["id"], r["status"], r["provider"]) for r in sent] == [("1", "success", "mock")]


def test_methods_limits_and_reasons(spark):
    with pytest.raises(ValueError, match="reader"):
        pipeline.run(asked(spark), corpus(spark), G.Profile(method="finetuned_reader"), RAG)
    with pytest.raises(ValueError, match="reranker"):
        pipeline.run(asked(spark), corpus(spark), G.Profile(method="hybrid_rag", reranker="mock"), RAG)
    profile = G.Profile(method="hybrid_rag", reranker="semantic", model="none")
    missing = rerank.for_profile("semantic", "none", asked(spark), corpus(spark))
    done = pipeline.run(asked(spark), corpus(spark), profile, RAG, rerank=missing, limit=1)
    row = done.predictions.collect()
    assert [(r["id"], r["fallback_reason"]) for r in row] == [("1", "reranker_unavailable")]
    assert pipeline.counts(done.predictions).first()["fallback_rate"] == 1.0
    assert pipeline.run(asked(spark), None, G.Profile(method="direct"), DIRECT).predictions.where("fallback_reason is not null").count() == 0


def test_a_hit_without_a_chunk_is_an_error(spark):
    hits = spark.createDataFrame([("1", "gone", 1)], "id string, chunk_id string, rank int")
    chunks = spark.createDataFrame([("c", "d", "p", None, None, "t", "t")], "chunk_id string, document_id string, source_path string, source_member string, section_label string, raw_text string, retrieval_text string")
    for operator in (evidence.pack, evidence.deduplicate):
        with pytest.raises(Exception, match="no chunk"):
            operator(hits, chunks).collect()


def test_lead_and_tail_of_cut_blocks(spark):
    texts = [("\n Điều 1\nnội dung", None), ("một dòng dài", "Điều 2"), ("Điều 3. tiếp", "điều 3"), ("a\r\nb", "x"), (" \n", "x"), ("Điều 4", "Điều 4")]
    df = spark.createDataFrame(texts, "t string, h string")
    lead, tail = evidence.lead_and_tail(F.col("t"), F.col("h"))
    assert [tuple(r) for r in df.select(lead, tail).collect()] == [("Điều 1", "nội dung"), ("Điều 2", "một dòng dài"), ("điều 3", ". tiếp"), ("a", "b"), ("", ""), ("Điều 4", "")]


def test_provider_codes():
    def client(error, **more):
        def send(*_):
            if isinstance(error, Exception):
                raise error
            return error

        return prompting.ChatClient("http://x", "m", retries=0, transport=send, **more)

    http = lambda code: urllib.error.HTTPError("http://x", code, "no", {}, None)
    cases = {
        "LLM_AUTH_ERROR": http(401), "LLM_RATE_LIMITED": http(429), "LLM_SERVER_ERROR": http(503), "LLM_PROVIDER_ERROR": http(404), "LLM_TIMEOUT": urllib.error.URLError(TimeoutError()),
        "LLM_CONNECTION_RESET": urllib.error.URLError(ConnectionResetError()), "LLM_TRANSPORT_ERROR": urllib.error.URLError("name"), "LLM_INVALID_RESPONSE": b"{}", "LLM_REQUEST_FAILED": RuntimeError("x"),
    }
    seen = set()
    for code, error in cases.items():
        with pytest.raises(prompting.ProviderError) as caught:
            client(error)("p")
        assert caught.value.code == code
        seen.add(code)
    for code, ask in (("EMPTY_PROMPT", lambda: client(b"")(" ")), ("MISSING_API_KEY", lambda: client(b"", needs_key=True)("p"))):
        with pytest.raises(prompting.ProviderError) as caught:
            ask()
        assert caught.value.code == code
        seen.add(code)
    assert seen | {"INVALID_MOCK_RESPONSE"} == set(prompting.ERROR_CODES)


def test_blank_mock_responses(spark):
    p = spark.createDataFrame([("1", "p"), ("2", "q")], "id string, prompt string")
    given = spark.createDataFrame([("p", " ")], "prompt string, response string")
    assert {r["id"]: r["error_code"] for r in prompting.mock_generate(p, given).collect()} == {"1": "INVALID_MOCK_RESPONSE", "2": None}


def test_submission_codes(tmp_path, spark):
    good = submission.to_json([("1", "a"), ("2", "b")])
    check = lambda data: {c for c, _ in submission.check_json(data, ["1", "2"], reject_empty=True)}
    found = set()
    for data in (b"\xff", b"{", b"[]", b'{"1": {"answer": "a"}, "1": {"answer": "a"}, " ": 1, "3": {}}', b'{"1": {"answer": 1}, "2": {"answer": " ", "x": 1}}'):
        found |= check(data)
    (tmp_path / "other.json").write_bytes(good)
    (tmp_path / "submission.json").write_bytes(good)
    (tmp_path / "bad.zip").write_bytes(b"x")
    for name, members in (("a.zip", ["x/submission.json"]), ("b.zip", ["y.txt"]), ("c.zip", ["submission.json", "y.txt"])):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for m in members:
                z.writestr(m, good)
    for name in ("none.json", "other.json", "bad.zip", "a.zip", "b.zip", "c.zip"):
        found |= {c for c, _ in submission.check_file(str(tmp_path / name), ["1", "2"])}
    assert submission.check_file(str(tmp_path / "submission.json"), ["1", "2"]) == []
    assert found == set(submission.CODES) and len(submission.CODES) == 18


def test_legacy_shapes(spark):
    expected, rows = spark.createDataFrame([("7", 0), ("5", 1)], "id string, pos int"), spark.createDataFrame([("5", "b", 1), ("7", "a", 0)], "id string, answer string, pos int")
    shape = lambda *a, **k: json.loads(submission.legacy(expected, rows, *a, **k))
    assert shape("list", integer_ids=True) == [{"id": 7, "answer": "a"}, {"id": 5, "answer": "b"}]
    assert shape("answer_map") == {"7": "a", "5": "b"} and shape("record_map", answer_field="x") == {"7": {"x": "a"}, "5": {"x": "b"}}
    with pytest.raises(ValueError):
        shape("answer_map", integer_ids=True)


def test_chunk_cache_states(spark, tmp_path):
    from lexforge.operators.chunking import chunk_documents

    root, chunks = str(tmp_path / "cache"), chunk_documents(corpus(spark))
    assert cache.read_chunks(spark, root, corpus="x")[:2] == ("miss", "cache_missing")
    path = cache.write_chunks(chunks, root, corpus="x")
    status, reason, found = cache.read_chunks(spark, root, corpus="x")
    assert (status, reason, found.count()) == ("hit", None, chunks.count())
    with pytest.raises(FileExistsError):
        cache.write_chunks(chunks, root, corpus="x")
    assert cache.read_chunks(spark, root, corpus="y")[0] == "miss"
    found.limit(1).write.mode("append").parquet(f"{path}/chunks")
    assert cache.read_chunks(spark, root, corpus="x")[:2] == ("stale", "summary_mismatch")
    cache.write_chunks(chunks, root, overwrite_stale=True, corpus="x")
    assert cache.read_chunks(spark, root, corpus="x")[0] == "hit"


def test_index_left_by_a_broken_write(spark, tmp_path):
    built = index.build(spark.createDataFrame([("c", "a b")], "chunk_id string, retrieval_text string"))
    path = index.store(built, str(tmp_path), k=1)
    assert index.load(spark, str(tmp_path), k=1)[1] == "hit"
    with pytest.raises(FileExistsError):
        index.store(built, str(tmp_path), k=1)
    import shutil

    shutil.rmtree(f"{path}/stats")
    assert index.load(spark, str(tmp_path), k=1)[1] == "index_missing"
    index.store(built, str(tmp_path), k=1)
    built.df.limit(1).write.mode("overwrite").parquet(f"{path}/df")
    assert index.load(spark, str(tmp_path), k=1)[1] == "index_inconsistent"


def test_reader_runs_and_checkpoints(spark, tmp_path):
    cases = spark.createDataFrame([("a", "phạt?", "Phạt 5 triệu"), ("b", "thuế?", None)], "id string, question string, context string")
    scored = reader.mock(lambda q, c: reader.Span(c[:4], len(c) / 100, 0, 4))
    own = {r["id"]: (r["answer"], r["source_origin"]) for r in reader.run(cases, scored, "finetuned_reader").predictions.collect()}
    assert own == {"a": ("Phạt", "original"), "b": ("", "original")}
    train = spark.createDataFrame([("t", 0, "thuế suất là mười phần trăm"), ("u", 1, "Phạt 5 triệu")], "case_id string, pos int, context string")
    done = reader.run(cases, scored, "tuned_bm25_reader", train, 2)
    best = {r["id"]: (r["answer"], r["source_case_id"]) for r in done.predictions.collect()}
    assert best == {"a": ("thuế", "t"), "b": ("thuế", "t")} and done.candidates.where("id = 'a'").count() == 2 and done.retrieval.count() == 2
    with pytest.raises(ValueError):
        reader.run(cases, scored, "tuned_bm25_reader")
    folder = tmp_path / "model"
    folder.mkdir()
    with pytest.raises(reader.ReaderUnavailable):
        reader.folder_digest(str(folder))
    (folder / "w").write_bytes(b"x")
    manifest = tmp_path / "m.json"
    manifest.write_text(json.dumps({"model": "m", "model_version": "1", "checkpoint_sha256": reader.folder_digest(str(folder))}))
    assert reader.checkpoint(str(folder), str(manifest))["model"] == "m"
    (folder / "w").write_bytes(b"y")
    with pytest.raises(reader.ReaderUnavailable, match="differs"):
        reader.checkpoint(str(folder), str(manifest))


def test_feasibility_audit(spark, tmp_path):
    q = spark.createDataFrame([("1", "Phạt bao nhiêu?", "5 triệu đồng", "train"), ("2", "Thuế?", None, "public")], "id string, question string, answer string, split string")
    chunks = spark.createDataFrame([("c", "d", "Phạt là 5 triệu đồng")], "chunk_id string, document_id string, retrieval_text string")
    shown = spark.createDataFrame([("1", "Phạt là 5 triệu đồng", "x", "Phạt là 5 triệu đồng")], "id string, evidence string, top1 string, top3 string")
    a = reports.feasibility(q, chunks, shown, RAG)
    assert a.status == "hard_stop" and "a leakage policy is broken" in a.reasons and a.sections["retrieval"]["exact_rate"] == 1.0
    frozen = G.freeze(**{n: "x" for n in G.FROZEN})
    clean = reports.feasibility(q, chunks.where("false"), shown, RAG, frozen, frozen, {"status": "verified"})
    assert clean.status == "pass" and clean.summary()["hard_stop"] is False
    reports.write_audit(clean, str(tmp_path / "audit"))
    assert json.loads((tmp_path / "audit/summary.json").read_text())["status"] == "pass"
    missing = reports.feasibility(q.where("split = 'public'"), None, None, RAG)
    assert "the train split is missing" in missing.reasons and missing.sections["splits"]["warmup"] == {"status": "missing"}


def test_freeze(tmp_path):
    frozen = G.freeze(profile="p")
    assert frozen["fields"]["index"] == "UNRESOLVED"
    with pytest.raises(ValueError, match="index"):
        G.require_frozen(frozen, frozen)
    whole = G.freeze(**{n: "x" for n in G.FROZEN})
    G.require_frozen(whole, whole)
    (tmp_path / "f.json").write_text(json.dumps(whole))
    assert G.load_freeze(str(tmp_path / "f.json")) == whole
    (tmp_path / "f.json").write_text(json.dumps(whole | {"sha256": "0"}))
    with pytest.raises(ValueError):
        G.load_freeze(str(tmp_path / "f.json"))
    assert G.training_policy(["train", "public"])["disallowed_splits"] == ["public"] and G.reference_policy()["pass"]


def test_reports_on_sources(spark, tmp_path):
    path = tmp_path / "c.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a.json", "{}")
        z.writestr("b.txt", "x")
    stats = reports.archive_stats(str(path))
    assert (stats["member_count"], stats["json_member_count"], stats["error"]) == (2, 1, None)
    assert reports.archive_stats(str(tmp_path / "none"))["exists"] is False and reports.archive_stats(str(tmp_path))["error"] == "not a file"
    q = spark.createDataFrame([("1", "abc", "x"), ("2", "abcd", None)], "id string, question string, answer string")
    problems = spark.createDataFrame([("s", "BAD", "")], files.PROBLEMS)
    report = reports.source_report(q, problems, 3, stats, "profile", "train")
    assert report["critical_errors"] == ["BAD: 1"] and report["questions"]["lengths"]["question"]["max"] == 4
    assert reports.write_source_report(report, str(tmp_path / "out"), "d" * 64) == reports.write_source_report(report, str(tmp_path / "out"), "d" * 64)


def test_markdown_and_csv_report(spark):
    report = spark.createDataFrame([(1, "a", None, None, "miss", None, None, "x\r\ny"), (2, "b", 0.5, 0.25, "success", [(1, "c", "d", "p|q")], "", "r")], "place bigint, id string, meteor double, rouge_l double, retrieval_status string, previews array<struct<rank:int,chunk_id:string,document_id:string,preview:string>>, prediction string, reference string")
    lines = [r["line"] for r in evaluation.markdown_lines(report, {"run_id": "r"}).orderBy("line_no").collect()]
    assert lines[0].startswith("# ") and lines[2] == "- run_id: `r`" and lines[5] == evaluation.REPORT_HEAD[0]
    assert lines[7] == "| 1 | a |  |  | OTHER | miss |  | <missing> | x<br>y |" and "0.500000 | 0.250000 | OTHER | success | [1] c p\\|q" in lines[8]
    assert tuple(evaluation.report_table(report).columns) == evaluation.REPORT_COLUMNS


def test_records_few_shot_and_metrics(spark, tmp_path):
    assert files.records(spark, {1: "a", "02": None}).count() == 2 and files.records(spark, [{"id": "x", "prediction": "p"}]).first()["answer"] == "p"
    for bad in ([("1", "a"), ("1", "b")], [(None, "a")], [("1", 5)]):
        with pytest.raises(ValueError):
            files.records(spark, bad)
    (tmp_path / "q.json").write_text(json.dumps([{"question_id": 1, "question": "Phạt?", "answer": "x"}, {"question_id": 2, "question": "Thuế?", "evidence": "Thuế 10"}]))
    answers, scores = fewshot.run(fewshot.load(spark, str(tmp_path / "q.json")), [("a", "b")])
    assert answers.where("status = 'success'").count() == 2 and scores.first()["n_cases"] == 1
    target = tmp_path / "m.json"
    sinks.write_report(str(target), {"a": 1})
    with pytest.raises(FileExistsError):
        sinks.write_report(str(target), {"a": 2})
    sinks.write_report(str(target), {"a": 2}, overwrite=True)
    s = spark.createDataFrame([("a", "scored", 0.5, 0.5)], "id string, status string, meteor double, rouge_l double")
    assert evaluation.metrics_report(s, split="warmup")["n_scored"] == 1


def test_release_deletes_stored_tables(spark):
    df = runtime.stored(spark.range(3))
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    import os

    assert os.path.isdir(path) and runtime.release(spark) >= 1 and not os.path.exists(path)
