"""Extractive reading: spans of candidate contexts by a reader, the most confident one per question."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stored
from .retrieval import reader_bm25, reader_candidates

METHODS = ("finetuned_reader", "tuned_bm25_reader")


class ReaderUnavailable(RuntimeError):
    """The configured reader cannot be used; nothing is downloaded in its place."""


@dataclass(frozen=True)
class Span:
    answer: str
    confidence: float
    start: int | None = None
    end: int | None = None
    impossible: bool = False


@dataclass(frozen=True)
class Reader:
    """A named reader; ``build()`` makes the function (question, context) -> Span once per task."""

    model: str
    version: str
    build: Callable[[], Callable[[str, str], Span]]


def mock(scorer: Callable[[str, str], Span], model: str = "mock-extractive-reader", version: str = "offline-v1") -> Reader:
    return Reader(model, version, lambda: scorer)


def folder_digest(folder: str) -> str:
    """SHA-256 over the relative paths and bytes of all files, in order of path."""
    files = sorted(p for p in Path(folder).rglob("*") if p.is_file())
    if not files:
        raise ReaderUnavailable(f"no files in {folder}")
    digest = hashlib.sha256()
    for path in files:
        digest.update(path.relative_to(folder).as_posix().encode())
        with path.open("rb") as file:
            while block := file.read(1 << 20):
                digest.update(block)
    return digest.hexdigest()


def checkpoint(folder: str, manifest: str) -> dict:
    """The manifest of a local checkpoint whose bytes are the ones it names."""
    if not os.path.isdir(folder):
        raise ReaderUnavailable(f"no checkpoint folder {folder}")
    try:
        with open(manifest, encoding="utf-8") as file:
            about = json.load(file)
    except (OSError, ValueError) as error:
        raise ReaderUnavailable(f"unreadable manifest {manifest}") from error
    for name in ("model", "model_version", "checkpoint_sha256"):
        if not isinstance(about, dict) or not isinstance(about.get(name), str) or not about[name].strip():
            raise ReaderUnavailable(f"manifest without {name}")
    if about["checkpoint_sha256"] != folder_digest(folder):
        raise ReaderUnavailable("checkpoint differs from its manifest")
    return about


def local(folder: str, manifest: str, max_length: int = 384, stride: int = 128, max_answer: int = 50) -> Reader:
    """A question-answering checkpoint on disk; needs the optional transformers library."""
    about = checkpoint(folder, manifest)

    def build() -> Callable[[str, str], Span]:
        try:
            from transformers import pipeline
        except ImportError as error:
            raise ReaderUnavailable("transformers is not installed") from error
        ask = pipeline("question-answering", model=folder, tokenizer=folder)

        def read(question: str, context: str) -> Span:
            found = ask(question=question, context=context, max_seq_len=max_length, doc_stride=stride, max_answer_len=max_answer, handle_impossible_answer=True)
            return Span(found["answer"], float(found["score"]), found["start"], found["end"], not found["answer"])

        return read

    return Reader(about["model"], about["model_version"], build)


def spans(candidates: DataFrame, reader: Reader) -> DataFrame:
    """Candidates (id, position, question, context, ...) with the reader's span of each; a narrow map.

    Null contexts give an impossible span of confidence 0.
    """
    kept = ["id", "position", "origin", "source_case_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = reader.build()
        for frame in frames:
            found = [Span("", 0.0, impossible=True) if c is None else read(q, c) for q, c in zip(frame["question"], frame["context"])]
            out = frame[kept].copy()
            out["answer"], out["confidence"] = [s.answer for s in found], [float(s.confidence) for s in found]
            out["start_char"], out["end_char"] = pd.array([s.start for s in found], "Int32"), pd.array([s.end for s in found], "Int32")
            out["impossible"] = [bool(s.impossible) for s in found]
            yield out

    schema = "id string, position int, origin string, source_case_id string, answer string, confidence double, start_char int, end_char int, impossible boolean"
    return candidates.select("id", F.col("position").cast("int").alias("position"), "origin", "source_case_id", "question", "context").mapInPandas(run, schema)


@dataclass
class Reading:
    """The tables of a run: predictions, all scored candidates, and the retrieval behind them (or None)."""

    predictions: DataFrame
    candidates: DataFrame
    retrieval: DataFrame | None


def run(cases: DataFrame, reader: Reader, method: str, train: DataFrame | None = None, top: int = 5) -> Reading:
    """Operator: cases (id, question, context) -> one prediction per case.

    ``finetuned_reader`` reads the case's own context.  ``tuned_bm25_reader`` also reads the
    contexts of the ``top`` train cases (case_id, pos, context) nearest to the question,
    each context once.  The most confident span wins, the earlier candidate on ties.
    """
    if method not in METHODS:
        raise ValueError(f"unknown reader method {method!r}")
    if (train is None) != (method == "finetuned_reader"):
        raise ValueError("train contexts belong to tuned_bm25_reader, and only to it")
    own = cases.select("id", "context")
    retrieval = None
    if train is None:
        chosen = own.select("id", F.lit(0).alias("position"), F.lit("original").alias("origin"), F.col("id").alias("source_case_id"), "context")
    else:
        hits = stored(reader_bm25(cases.select("id", "question"), train, top))
        chosen = reader_candidates(own, hits, train.select("case_id", "context"))
        shown = F.array_sort(F.collect_list(F.struct("rank", F.col("case_id").alias("source_case_id"), F.col("score").alias("bm25_score"))))
        retrieval = hits.groupBy("id").agg(shown.alias("hits")).join(cases.select("id", F.sha2("question", 256).alias("query_sha256")), "id")
    scored = stored(spans(chosen.join(cases.select("id", "question"), "id"), reader))
    best = scored.groupBy("id").agg(F.max_by(F.struct("answer", "confidence", "source_case_id", F.col("origin").alias("source_origin")), F.struct(F.col("confidence"), -F.col("position"))).alias("b"))
    predictions = best.select("id", "b.*").withColumns({"method": F.lit(method), "model": F.lit(reader.model), "model_version": F.lit(reader.version)})
    return Reading(predictions, scored, retrieval)
