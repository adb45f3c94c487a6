"""Submission rules as rows, the submission file and its archive, manifests."""

from __future__ import annotations

import io
import json
import os
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The codes of a submission's issues.
CODES = (
    "SUBMISSION_FILE_NOT_FOUND",
    "SUBMISSION_WRONG_FILENAME",
    "SUBMISSION_INVALID_UTF8",
    "SUBMISSION_INVALID_JSON",
    "SUBMISSION_TOP_LEVEL_NOT_OBJECT",
    "SUBMISSION_INVALID_QUESTION_ID",
    "SUBMISSION_DUPLICATE_QUESTION_ID",
    "SUBMISSION_MISSING_QUESTION_ID",
    "SUBMISSION_EXTRA_QUESTION_ID",
    "SUBMISSION_VALUE_NOT_OBJECT",
    "SUBMISSION_MISSING_ANSWER",
    "SUBMISSION_ANSWER_NOT_STRING",
    "SUBMISSION_EXTRA_FIELDS",
    "SUBMISSION_EMPTY_ANSWER",
    "SUBMISSION_ZIP_INVALID",
    "SUBMISSION_ZIP_WRONG_LAYOUT",
    "SUBMISSION_ZIP_EXTRA_MEMBER",
    "SUBMISSION_ZIP_MISSING_JSON",
)
MEMBER = "submission.json"


def violations(expected: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, code) of rows (id, pos, answer) against the expected ids (id, pos).

    Ids are compared as strings; blank ids, repeats, missing and extra ids, answers that are
    null or blank, and right ids in another order all come out, each once per id.
    """
    e = expected.groupBy("id").agg(F.min("pos").alias("at"))
    r = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("found_at"), F.count("answer").alias("n_answers"), F.count_if(~F.col("answer").rlike(r"(?U)[^\s]")).alias("n_blank"))
    both = e.join(r, "id", "full")
    present = F.col("n").isNotNull()
    code = F.array(
        F.when(present & ~F.coalesce(F.col("id").rlike(r"(?U)[^\s]"), F.lit(False)), F.lit("SUBMISSION_INVALID_QUESTION_ID")),
        F.when(F.col("n") > 1, F.lit("SUBMISSION_DUPLICATE_QUESTION_ID")),
        F.when(~present, F.lit("SUBMISSION_MISSING_QUESTION_ID")),
        F.when(F.col("at").isNull(), F.lit("SUBMISSION_EXTRA_QUESTION_ID")),
        F.when(F.col("at").isNotNull() & present & (F.col("n_answers") < F.col("n")), F.lit("SUBMISSION_ANSWER_NOT_STRING")),
        F.when(F.col("at").isNotNull() & (F.col("n_blank") > 0), F.lit("SUBMISSION_EMPTY_ANSWER")),
        F.when(F.col("at") != F.col("found_at"), F.lit("SUBMISSION_INVALID_QUESTION_ID")),
    )
    return both.select("id", F.explode(F.array_distinct(F.filter(code, lambda x: x.isNotNull()))).alias("code"))


def payload(expected: DataFrame, rows: DataFrame) -> DataFrame:
    """(pos, id, answer) in the order of the dataset; fails unless the ids cover each other exactly."""
    issues = violations(expected, rows).where("code <> 'SUBMISSION_EMPTY_ANSWER'").orderBy("code", "id").limit(1).collect()
    if issues:
        raise ValueError(f"{issues[0]['code']}: {issues[0]['id']}")
    return expected.select("id", "pos").join(rows.select("id", "answer"), "id").orderBy("pos")


def to_json(rows: list[tuple[str, str]]) -> bytes:
    """The submission object in row order."""
    return (json.dumps({i: {"answer": a} for i, a in rows}, ensure_ascii=False, indent=2) + "\n").encode()


def check_json(data: bytes, expected: list[str], *, reject_empty: bool = False) -> list[tuple[str, str]]:
    """(code, id) of every issue of a submission file, in a stable order."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return [("SUBMISSION_INVALID_UTF8", "")]
    issues: list[tuple[str, str]] = []
    repeated: list[str] = []

    def pairs(items):
        seen = {}
        for k, v in items:
            if k in seen:
                repeated.append(k)
            seen[k] = v
        return seen

    try:
        value = json.loads(text, object_pairs_hook=pairs)
    except ValueError:
        return [("SUBMISSION_INVALID_JSON", "")]
    if not isinstance(value, dict):
        return [("SUBMISSION_TOP_LEVEL_NOT_OBJECT", "")]
    issues += [("SUBMISSION_DUPLICATE_QUESTION_ID", k) for k in repeated]
    issues += [("SUBMISSION_INVALID_QUESTION_ID", k) for k in value if not k.strip()]
    issues += [("SUBMISSION_MISSING_QUESTION_ID", k) for k in expected if k not in value]
    wanted = set(expected)
    issues += [("SUBMISSION_EXTRA_QUESTION_ID", k) for k in value if k not in wanted]
    for k, v in value.items():
        if not isinstance(v, dict):
            issues.append(("SUBMISSION_VALUE_NOT_OBJECT", k))
        elif "answer" not in v:
            issues.append(("SUBMISSION_MISSING_ANSWER", k))
        elif not isinstance(v["answer"], str):
            issues.append(("SUBMISSION_ANSWER_NOT_STRING", k))
        else:
            issues += [("SUBMISSION_EXTRA_FIELDS", k)] * (len(v) > 1)
            issues += [("SUBMISSION_EMPTY_ANSWER", k)] * (not v["answer"].strip() and reject_empty)
    if not issues and list(value) != list(expected):
        issues.append(("SUBMISSION_INVALID_QUESTION_ID", next(a for a, b in zip(value, expected) if a != b)))
    return issues


def to_zip(data: bytes, member: str = MEMBER) -> bytes:
    """An archive of one member whose bytes depend on nothing but its content."""
    info = zipfile.ZipInfo(member, (1980, 1, 1, 0, 0, 0))
    info.external_attr, info.compress_type = 0o600 << 16, zipfile.ZIP_DEFLATED
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr(info, data)
    return out.getvalue()


def check_zip(data: bytes, expected: list[str], member: str = MEMBER, *, reject_empty: bool = False) -> list[tuple[str, str]]:
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        names = archive.namelist()
    except zipfile.BadZipFile:
        return [("SUBMISSION_ZIP_INVALID", "")]
    if member not in names:
        return [("SUBMISSION_ZIP_WRONG_LAYOUT" if any(n.endswith("/" + member) for n in names) else "SUBMISSION_ZIP_MISSING_JSON", "")]
    extra = [("SUBMISSION_ZIP_EXTRA_MEMBER", n) for n in names if n != member]
    return extra or check_json(archive.read(member), expected, reject_empty=reject_empty)


def check_file(path: str, expected: list[str], *, reject_empty: bool = False) -> list[tuple[str, str]]:
    """(code, id) of every issue of a submission on disk: ``submission.json`` or an archive of it."""
    name = os.path.basename(path)
    if not os.path.isfile(path):
        return [("SUBMISSION_FILE_NOT_FOUND", name)]
    with open(path, "rb") as file:
        data = file.read()
    if name.lower().endswith(".zip"):
        return check_zip(data, expected, reject_empty=reject_empty)
    if name != MEMBER:
        return [("SUBMISSION_WRONG_FILENAME", name)]
    return check_json(data, expected, reject_empty=reject_empty)


def legacy(expected: DataFrame, rows: DataFrame, shape: str, id_field: str = "id", answer_field: str = "answer", integer_ids: bool = False) -> bytes:
    """The older shapes, as described by the caller, never guessed: ``list`` of records, ``answer_map`` or ``record_map``.

    Integer ids are only possible in a list; an id that is no canonical integer is refused.
    """
    if shape not in ("list", "answer_map", "record_map"):
        raise ValueError(f"unknown shape {shape!r}")
    if integer_ids and shape != "list":
        raise ValueError("integer ids need a list")
    out: list | dict = [] if shape == "list" else {}
    for r in payload(expected, rows).toLocalIterator():
        id_: str | int = r["id"]
        if integer_ids:
            if str(int(id_)) != id_:
                raise ValueError(f"not a canonical integer: {id_}")
            id_ = int(id_)
        if shape == "list":
            out.append({id_field: id_, answer_field: r["answer"]})
        else:
            out[id_] = r["answer"] if shape == "answer_map" else {answer_field: r["answer"]}
    return (json.dumps(out, ensure_ascii=False, indent=2) + "\n").encode()


def manifest_diff(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(path, issue) of manifests (path, size, sha256): missing, extra or mismatching files."""
    a = expected.select("path", F.struct("size", "sha256").alias("a"))
    b = found.select("path", F.struct("size", "sha256").alias("b"))
    issue = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(~F.col("a").eqNullSafe(F.col("b")), "mismatch")
    return a.join(b, "path", "full").select("path", issue.alias("issue")).where("issue is not null")
