import json
import zipfile

import pytest

from lexforge.governance import Profile, drift, redacted, redacted_command, require_references, require_right
from lexforge.operators import submission as S
from lexforge.sources import files, sinks


def test_context_folder_and_zip(spark, tmp_path, rows):
    folder = tmp_path / "c" / "nested"
    folder.mkdir(parents=True)
    contents = {
        "context_10.json": {"id": 10, "name": "Văn bản 10", "passage": "Điều 10."},
        "context_2.JSON": {"id": "2", "passage": "x"},
        "context_3.json": {"id": 3, "passage": "  "},
    }
    for name, value in contents.items():
        (folder / name).write_text(json.dumps(value, ensure_ascii=False), encoding="utf-8")
    (folder / "README.txt").write_text("x")
    parsed = files.read_context_folder(spark, str(tmp_path / "c"))
    assert rows(files.good(parsed).select("id", "name")) == [("10", "Văn bản 10"), ("2", "2")]
    assert sorted(r["code"] for r in files.problems(parsed).collect()) == ["BLANK_PASSAGE", "UNRELATED_FILE"]
    assert files.corpus(parsed).count() == 2
    archive = tmp_path / "c.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for name, value in contents.items():
            z.writestr(f"n/{name}", json.dumps(value))
        z.writestr("n/context_9.json", '{"id": 1, "id": 2, "passage": "x"}')
    zipped = files.read_context_zip(spark, str(archive), 2)
    assert rows(files.good(zipped).select("id", "source_member")) == [("10", "n/context_10.json"), ("2", "n/context_2.JSON")]
    assert "DUPLICATE_KEY" in {r["code"] for r in files.problems(zipped).collect()}
    with pytest.raises(Exception, match="DUPLICATE_KEY"):
        files.corpus(zipped).collect()


def test_questions_keep_order_and_withhold_answers(spark, tmp_path):
    path = tmp_path / "q.json"
    path.write_text('{"007": {"question": " Hỏi? ", "answer": "Đáp"}, "2": {"question": "x"}, "1": {"question": " "}, "2": {"question": "y"}}', encoding="utf-8")
    parsed = files.read_questions(spark, str(path), "train", answers=True)
    assert [(r["pos"], r["id"], r["answer"]) for r in files.good(parsed).orderBy("pos").collect()] == [(0, "007", "Đáp"), (1, "2", None)]
    assert sorted((r["code"], r["detail"]) for r in files.problems(parsed).collect()) == [("BLANK_QUESTION", "1"), ("DUPLICATE_ID", "2")]
    with pytest.raises(PermissionError):
        files.read_questions(spark, "/nowhere", "private", answers=True)
    assert [r["pos"] for r in files.good(files.read_target_ids(spark, str(path))).orderBy("pos").collect()] == [0, 1, 2]


def test_records_in_all_shapes(spark, tmp_path, rows):
    shapes = {"a.json": '{"1": "x", "2": {"prediction": "y"}}', "b.json": '[{"id": 1, "answer": "x"}]', "c.json": '{"records": [{"id": "3", "reference": "z"}]}', "d.jsonl": '{"id": 4, "answer": "w"}\n\n{bad\n'}
    for name, text in shapes.items():
        (tmp_path / name).write_text(text)
    parsed = files.read_eval_records(spark, str(tmp_path))
    assert rows(files.good(parsed).select("id", "answer")) == [("1", "x"), ("1", "x"), ("2", "y"), ("3", "z"), ("4", "w")]
    assert files.problems(parsed).count() == 1
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "p.jsonl").write_text('{"id": "1", "answer": "a"}\n{"id": "1", "answer": "b"}\n{"id": "2", "answer": "c", "x": 1}\n')
    p = files.read_predictions(spark, str(tmp_path / "p"))
    assert sorted(r["code"] for r in files.problems(p).collect()) == ["DUPLICATE_ID", "UNKNOWN_FIELD"] and files.good(p).count() == 1


def test_reader_csv_and_splits(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_bytes('﻿context,question,answer\n"a\nb",q0,x\nc,q1,y\n'.encode())
    cases = files.fail_on(files.read_reader_csv(spark, str(path)))
    assert [(r["id"], r["context"]) for r in cases.orderBy("row").collect()] == [("vilqa-0", "a\nb"), ("vilqa-1", "c")]
    assert files.split_cases(cases, {"train": ["vilqa-0"], "test": ["vilqa-1"]}).count() == 2
    with pytest.raises(Exception, match="does not cover"):
        files.split_cases(cases, {"train": ["vilqa-0"]}).collect()
    with pytest.raises(ValueError):
        files.split_cases(cases, {"train": ["vilqa-0"], "test": ["vilqa-0"]})


def test_manifest_and_diff(spark, tmp_path, rows):
    (tmp_path / "cache").mkdir()
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "cache" / "b.txt").write_text("y")
    m = files.manifest(spark, str(tmp_path))
    assert [r["path"] for r in m.collect()] == ["a.txt"]
    other = spark.createDataFrame([("a.txt", 2, "h"), ("z", 1, "h")], "path string, size long, sha256 string")
    assert rows(S.manifest_diff(other, m)) == [("a.txt", "mismatch"), ("z", "missing")]


def test_sinks(spark, tmp_path):
    path = sinks.write_json(str(tmp_path), "x/a.json", {"b": 1, "api_key": "s"})
    assert json.loads(path.read_text()) == {"api_key": "<redacted>", "b": 1}
    sinks.write_json(str(tmp_path), "x/a.json", {"b": 1, "api_key": "other"})
    with pytest.raises(sinks.Conflict):
        sinks.write_json(str(tmp_path), "x/a.json", {"b": 2})
    with pytest.raises(PermissionError):
        sinks.write_once(str(tmp_path), "../y", b"")
    runs = spark.createDataFrame([("r1", 0.5)], "run_id string, meteor double")
    sinks.append_runs(spark, runs, str(tmp_path / "runs"))
    with pytest.raises(sinks.Conflict):
        sinks.append_runs(spark, runs, str(tmp_path / "runs"))
    assert len(sinks.folder_hash(files.manifest(spark, str(tmp_path / "x")))) == 64


def test_submission_rules(spark, rows):
    expected = spark.createDataFrame([("007", 0), ("2", 1), ("1", 2), ("4", 3)], "id string, pos int")
    found = spark.createDataFrame([("007", 0, "a"), ("2", 1, " "), ("2", 1, "b"), ("9", 2, "c"), ("4", 3, None)], "id string, pos int, answer string")
    assert rows(S.violations(expected, found)) == [("1", "SUBMISSION_MISSING_QUESTION_ID"), ("2", "SUBMISSION_DUPLICATE_QUESTION_ID"), ("2", "SUBMISSION_EMPTY_ANSWER"), ("4", "SUBMISSION_ANSWER_NOT_STRING"), ("9", "SUBMISSION_EXTRA_QUESTION_ID")]
    ids = ["007", "2"]
    data = S.to_json([("007", "a"), ("2", "b")])
    assert S.check_json(data, ids) == [] and S.check_zip(S.to_zip(data), ids) == [] and S.to_zip(data) == S.to_zip(data)
    assert S.check_json(S.to_json([("2", "b"), ("007", "a")]), ids) == [("SUBMISSION_INVALID_QUESTION_ID", "2")]
    bad = b'{"007": {"answer": 1}, "2": {"x": 1}, "3": [], "3": []}'
    assert {c for c, _ in S.check_json(bad, ids)} == {"SUBMISSION_DUPLICATE_QUESTION_ID", "SUBMISSION_EXTRA_QUESTION_ID", "SUBMISSION_ANSWER_NOT_STRING", "SUBMISSION_MISSING_ANSWER", "SUBMISSION_VALUE_NOT_OBJECT"}
    assert S.check_json(b"\xff", ids) == [("SUBMISSION_INVALID_UTF8", "")] and S.check_json(b"[]", ids) == [("SUBMISSION_TOP_LEVEL_NOT_OBJECT", "")] and S.check_zip(b"x", ids) == [("SUBMISSION_ZIP_INVALID", "")]


def test_governance():
    require_right("public", "inference")
    for split, right in (("train", "inference"), ("public", "evaluate")):
        with pytest.raises(PermissionError):
            require_right(split, right)
    with pytest.raises(PermissionError):
        require_references("warmup", "none")
    assert redacted({"a": [{"Access-Token": 1}]}) == {"a": [{"Access-Token": "<redacted>"}]}
    assert redacted_command(["run", "--api-key", "x", "--token=y", "z"]) == ["run", "--api-key", "<redacted>", "--token=<redacted>", "z"]
    for bad in ({"chunk_overlap_chars": 1200}, {"b": 2}, {"reranker": "mock"}, {"data": "/abs"}, {"extra": {"secret": 1}}):
        with pytest.raises(ValueError):
            Profile(**bad)
    assert Profile().fingerprint == Profile().fingerprint != Profile(candidates=13).fingerprint
    assert drift({"a": 1, "b": "UNRESOLVED"}, {"a": 2, "b": "UNRESOLVED"}) == [("a", 1, 2), ("b", "UNRESOLVED", "UNRESOLVED")]
