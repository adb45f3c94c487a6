"""The tables as the queries see them: each key once, re-deliveries settled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import latest, table


def questions(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "legal_questions").select("id", "question", "answer", "split", "source", "received_at"), ["id"])


def predictions(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "predictions").drop("created_at"), ["id", "method"])


def documents(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "legal_documents").drop("created_at"), ["id"])


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "legal_chunks"), ["chunk_id"], None)


def hits(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "retrieval_hits").drop("created_at"), ["id", "method", "rank"])


def asked(id_: Column | str = "id") -> Column:
    """The stated query set of searches: ids divisible by 50, against all rows."""
    return F.expr(f"try_cast({id_} as bigint) % 50 = 0") if isinstance(id_, str) else id_.try_cast("bigint") % 50 == 0


# The same views for DuckDB, as CTEs.
SQL = {
    "q": "q as (select id, question, answer, split, source from (select *, row_number() over (partition by id order by received_at desc) rn from legal_questions) where rn = 1)",
    "p": "p as (select id, method, answer, status, error_code, fallback_reason, run_id from (select *, row_number() over (partition by id, method order by received_at desc) rn from predictions) where rn = 1)",
    "d": "d as (select id, name, passage, source_path, source_member, content_hash, link from (select *, row_number() over (partition by id order by received_at desc) rn from legal_documents) where rn = 1)",
    "c": "c as (select * exclude (rn) from (select *, row_number() over (partition by chunk_id) rn from legal_chunks) where rn = 1)",
    "h": "h as (select id, method, chunk_id, document_id, source_path, rank, bm25_score, rerank_score from (select *, row_number() over (partition by id, method, rank order by received_at desc) rn from retrieval_hits) where rn = 1)",
}


def ctes(*names: str) -> str:
    return "with " + ", ".join(SQL[n] for n in names)
