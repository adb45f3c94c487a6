"""Strict parsers of source files; they run inside Arrow batches and never on the driver.

Every parser returns rows and problems instead of raising, so that one bad file costs its
own rows; ``fail_on`` turns problems into a failed query where the contract is fail-closed.
"""

from __future__ import annotations

import json
from typing import Any


class Repeated(dict):
    """A JSON object that remembers keys given more than once."""

    repeated: list[str]


def strict_object(items: list[tuple[str, Any]]) -> Repeated:
    out = Repeated()
    out.repeated = []
    for key, value in items:
        if key in out:
            out.repeated.append(key)
        else:
            out[key] = value
    return out


def load_json(data: bytes) -> tuple[Any, str | None]:
    """(value, problem): UTF-8 only, repeated keys kept on their objects, NaN refused."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None, "INVALID_UTF8"

    def refuse(name: str):
        raise ValueError(name)

    try:
        return json.loads(text, object_pairs_hook=strict_object, parse_constant=refuse), None
    except (ValueError, RecursionError):
        return None, "INVALID_JSON"


def canonical_id(value: Any) -> str | None:
    """The id as a string with its spelling; null, booleans, objects and blanks are no ids."""
    if value is None or isinstance(value, (bool, dict, list)):
        return None
    text = str(value)
    return text if text.strip() else None


DOCUMENT_FIELDS = {"id", "name", "passage", "link"}


def document(data: bytes) -> tuple[dict | None, str | None]:
    """(document, problem) of one context file; a missing name is the id, a blank passage is skipped."""
    value, problem = load_json(data)
    if problem:
        return None, problem
    if not isinstance(value, dict):
        return None, "NOT_AN_OBJECT"
    if value.repeated:
        return None, "DUPLICATE_KEY"
    if set(value) - DOCUMENT_FIELDS:
        return None, "UNKNOWN_FIELD"
    id_ = canonical_id(value.get("id"))
    if id_ is None:
        return None, "INVALID_ID"
    passage, name, link = value.get("passage"), value.get("name"), value.get("link")
    if passage is not None and not isinstance(passage, str) or any(x is not None and not isinstance(x, str) for x in (name, link)):
        return None, "INVALID_FIELD"
    if not (passage or "").strip():
        return None, "BLANK_PASSAGE"
    return {"id": id_, "name": name if (name or "").strip() else id_, "passage": passage, "link": link}, None


def question_map(data: bytes, answers: bool) -> tuple[list[tuple[int, str, str | None, str | None]], list[tuple[str, str]]]:
    """(rows (pos, id, question, answer), problems (code, id)) of a map from id to question and answer.

    The order of the file is kept.  Answers are never returned unless asked for.
    """
    value, problem = load_json(data)
    if problem or not isinstance(value, dict):
        return [], [(problem or "TOP_LEVEL_NOT_OBJECT", "")]
    rows, problems = [], [("DUPLICATE_ID", k) for k in value.repeated]
    for pos, (key, body) in enumerate(value.items()):
        if canonical_id(key) is None:
            problems.append(("INVALID_ID", key))
        elif not isinstance(body, dict) or set(body) - {"question", "answer"} or body.repeated:
            problems.append(("INVALID_RECORD", key))
        elif not isinstance(body.get("question"), str) or not body["question"].strip():
            problems.append(("BLANK_QUESTION", key))
        elif body.get("answer") is not None and not isinstance(body["answer"], str):
            problems.append(("INVALID_ANSWER", key))
        else:
            rows.append((pos, key, body["question"], body.get("answer") if answers else None))
    return rows, problems


def eval_records(data: bytes, lines: bool) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(rows (id, answer), problems) of a map, a list, {"records": [...]} or JSON lines.

    The answer is the first string among answer, prediction and reference.
    """
    problems: list[tuple[str, str]] = []
    if lines:
        items = []
        for n, line in enumerate(data.split(b"\n"), 1):
            if line.strip():
                value, problem = load_json(line)
                if problem:
                    problems.append((problem, f"line {n}"))
                else:
                    items.append(value)
    else:
        value, problem = load_json(data)
        if problem:
            return [], [(problem, "")]
        if isinstance(value, dict) and isinstance(value.get("records"), list) and len(value) == 1:
            value = value["records"]
        if isinstance(value, dict):
            problems += [("DUPLICATE_ID", k) for k in value.repeated]
            items = [{"id": k, **(v if isinstance(v, dict) else {"answer": v})} for k, v in value.items()]
        elif isinstance(value, list):
            items = value
        else:
            return [], [("NOT_RECORDS", "")]
    rows = []
    for item in items:
        if not isinstance(item, dict):
            problems.append(("INVALID_RECORD", ""))
            continue
        id_ = canonical_id(item.get("id"))
        answer = next((item[k] for k in ("answer", "prediction", "reference") if isinstance(item.get(k), str)), None)
        if id_ is None or answer is None:
            problems.append(("INVALID_ID" if id_ is None else "MISSING_ANSWER", id_ or ""))
        else:
            rows.append((id_, answer))
    return rows, problems


PREDICTION_FIELDS = ("id", "answer", "method", "status", "error_code", "fallback_reason")


def predictions(data: bytes, lines: bool) -> tuple[list[tuple], list[tuple[str, str]]]:
    """(rows of PREDICTION_FIELDS, problems); unknown fields and repeated ids are problems."""
    if lines:
        parsed = [load_json(x) for x in data.split(b"\n") if x.strip()]
        items, problems = [v for v, p in parsed if not p], [(p, "") for _, p in parsed if p]
    else:
        value, problem = load_json(data)
        if problem:
            return [], [(problem, "")]
        items, problems = (value.get("records") if isinstance(value, dict) else value), []
    if not isinstance(items, list):
        return [], [("NOT_RECORDS", "")]
    rows, seen = [], set()
    for item in items:
        id_ = canonical_id(item.get("id")) if isinstance(item, dict) else None
        if id_ is None:
            problems.append(("INVALID_ID", ""))
        elif set(item) - set(PREDICTION_FIELDS):
            problems.append(("UNKNOWN_FIELD", id_))
        elif not isinstance(item.get("answer"), str):
            problems.append(("ANSWER_NOT_STRING", id_))
        elif id_ in seen:
            problems.append(("DUPLICATE_ID", id_))
        else:
            seen.add(id_)
            rows.append((id_, item["answer"], item.get("method"), item.get("status", "success"), item.get("error_code"), item.get("fallback_reason")))
    return rows, problems


def target_ids(data: bytes) -> tuple[list[tuple[int, str]], list[tuple[str, str]]]:
    """(rows (pos, id), problems) of a list of ids, of records, {"ids"|"records": [...]} or a map's keys."""
    value, problem = load_json(data)
    if problem:
        return [], [(problem, "")]
    if isinstance(value, dict):
        for name in ("ids", "records"):
            if isinstance(value.get(name), list) and len(value) == 1:
                value = value[name]
                break
        else:
            return [(n, k) for n, k in enumerate(value)], [("DUPLICATE_ID", k) for k in value.repeated]
    if not isinstance(value, list):
        return [], [("NOT_RECORDS", "")]
    ids = [canonical_id(x.get("id") if isinstance(x, dict) else x) for x in value]
    seen: set = set()
    repeated = [i for i in ids if i is not None and (i in seen or seen.add(i))]
    return [(n, i) for n, i in enumerate(ids) if i is not None], [("INVALID_ID", "")] * ids.count(None) + [("DUPLICATE_ID", i) for i in repeated]
