"""Ranked retrieval for all questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bounded_preview, legal_tokens, word_tokens
from ..runtime import stored
from . import topscores
from .index import Index, bags

K1, B = 1.5, 0.75


def bm25(questions: DataFrame, index: Index, top: int = 12, k1: float = K1, b: float = B) -> DataFrame:
    """(id, chunk_id, rank, bm25_score) of the ``top`` chunks with positive score.

    Distinct question terms; ties by chunk id; scores are ranked at nine decimals, so the
    order of summation cannot show.  Chunks are packed into blocks of asked postings, of which
    each returns its best chunks per question (``topscores``): no row per question, term and chunk.
    """
    if top < 1 or k1 <= 0 or not 0 <= b <= 1:
        raise ValueError("top and k1 must be positive and b within [0, 1]")
    asked = questions.select("id", F.array_distinct(legal_tokens(F.col("question"))).alias("terms"))
    texts = bags(index).select(F.col("chunk_id").alias("key"), F.col("chunk_id").alias("tie"), "dl", "terms", *(["tfs"] if index.texts is None else []))
    scored = topscores.best(asked, texts, top, k1, b).select("id", F.col("key").alias("chunk_id"), F.col("score").alias("bm25_score"))
    return _ranked(scored, "id", "bm25_score", "chunk_id", top).select("id", "chunk_id", "bm25_score", "rank")


def _ranked(scored: DataFrame, by: str, score: str, tie: str, top: int | None) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc(score), F.asc(tie))
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top) if top else ranked


def reader_bm25(questions: DataFrame, cases: DataFrame, top: int = 5, k1: float = K1, b: float = B) -> DataFrame:
    """(id, case_id, rank, score): folded word runs, repeated question terms count, average length at least 1.

    ``cases`` is (case_id, pos, context); ties go to the earlier position, and cases without
    a common term fill up with score 0, in source order, as far as ``top`` asks.
    """
    texts = cases.select(F.col("case_id").alias("key"), F.col("pos").alias("tie"), word_tokens(F.col("context")).alias("terms"))
    texts = texts.select("key", "tie", F.coalesce(F.size("terms"), F.lit(0)).alias("dl"), "terms")
    asked = questions.select("id", word_tokens(F.col("question")).alias("terms"))
    scored = topscores.best(asked, texts, top, k1, b, least_average=1.0).select("id", F.col("key").alias("chunk_id"), F.col("tie").alias("pos"), "score")
    best = stored(_ranked(scored, "id", "score", "pos", top))
    # zero scores: the first cases in source order can fill at most ``top`` places; where some are free, ``best`` holds every other case
    first = cases.orderBy("pos").limit(2 * top).select(F.col("case_id").alias("chunk_id"), "pos")
    full = best.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= top).select("id")
    blank = questions.select("id").join(full, "id", "left_anti").crossJoin(F.broadcast(first)).withColumn("score", F.lit(0.0))
    blank = blank.join(best.select("id", "chunk_id"), ["id", "chunk_id"], "left_anti")
    filled = best.drop("rank").unionByName(blank.select("id", "chunk_id", "pos", "score"))
    return _ranked(filled.select("id", "chunk_id", "pos", "score"), "id", "score", "pos", top).select("id", F.col("chunk_id").alias("case_id"), "rank", "score")


def inspect(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits with document name, section label and a preview of at most 240 characters."""
    c = chunks.select("chunk_id", "document_id", "section_label", "retrieval_text")
    d = documents.select(F.col("id").alias("document_id"), "name")
    return (
        hits.join(c, "chunk_id")
        .join(d, "document_id", "left")
        .select(
            "id", "rank", "chunk_id", "document_id", F.coalesce("name", "document_id").alias("document_name"),
            F.coalesce("section_label", F.lit("(unlabeled)")).alias("section_label"), "bm25_score",
            bounded_preview(F.col("retrieval_text")).alias("preview"),
        )
    )


def reader_candidates(cases: DataFrame, hits: DataFrame, contexts: DataFrame) -> DataFrame:
    """(id, position, origin, source_case_id, context): the case's own context first, then retrieved ones not seen before."""
    own = cases.select("id", F.lit(0).alias("place"), F.lit("original").alias("origin"), F.col("id").alias("source_case_id"), "context")
    found = hits.join(contexts, "case_id").select("id", F.col("rank").alias("place"), F.lit("train_retrieval").alias("origin"), F.col("case_id").alias("source_case_id"), "context")
    first = F.row_number().over(Window.partitionBy("id", F.sha2("context", 256)).orderBy("place"))
    kept = own.unionByName(found).withColumn("copy", first).where("copy = 1")
    place = F.row_number().over(Window.partitionBy("id").orderBy("place")) - 1
    return kept.select("id", place.alias("position"), "origin", "source_case_id", "context")


def best_span(candidates: DataFrame) -> DataFrame:
    """(id, position, answer, confidence): the most confident candidate, the earlier one on ties."""
    order = F.struct(F.col("confidence"), -F.col("position"))
    return candidates.groupBy("id").agg(F.max_by(F.struct("position", "answer", "confidence"), order).alias("b")).select("id", "b.*")
