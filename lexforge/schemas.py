"""Closed table schemas, and rules whose violations come out as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind, not name.endswith("_required")) for name, kind in fields.items()])


QUESTION = _struct(id=StringType(), question=StringType(), answer=StringType(), split=StringType())
DOCUMENT = _struct(
    id=StringType(), name=StringType(), passage=StringType(), source_path=StringType(),
    source_member=StringType(), content_hash=StringType(), link=StringType(),
)
CHUNK = _struct(
    chunk_id=StringType(), document_id=StringType(), source_path=StringType(), source_member=StringType(),
    section_label=StringType(), raw_text=StringType(), retrieval_text=StringType(), content_hash=StringType(),
    chunker_version=StringType(), start_offset=IntegerType(), end_offset=IntegerType(),
)
HIT = _struct(id=StringType(), chunk_id=StringType(), document_id=StringType(), source_path=StringType(), rank=IntegerType(), bm25_score=DoubleType(), rerank_score=DoubleType())
PREDICTION = _struct(id=StringType(), answer=StringType(), method=StringType(), status=StringType(), error_code=StringType(), fallback_reason=StringType())
EVAL_RECORD = _struct(id=StringType(), answer=StringType())
INDEXED = StructType(
    [
        StructField("chunk_id", StringType()),
        StructField("term_frequencies", ArrayType(StructType([StructField("term", StringType()), StructField("tf", IntegerType())]))),
        StructField("document_length", IntegerType()),
    ]
)


def not_blank(name: str) -> Column:
    """A string with at least one character that is no white space."""
    return F.coalesce(F.col(name).rlike(r"(?U)[^\s]"), F.lit(False))


def chunk_rules() -> dict[str, Column]:
    """What a chunk must hold (null results count as broken)."""
    return {
        "chunk_id_blank": not_blank("chunk_id"),
        "document_id_blank": not_blank("document_id"),
        "raw_text_blank": not_blank("raw_text"),
        "retrieval_text_blank": not_blank("retrieval_text"),
        "one_offset_missing": F.col("start_offset").isNull() == F.col("end_offset").isNull(),
        "offsets_not_ascending": F.coalesce(F.col("end_offset") > F.col("start_offset"), F.lit(True)),
    }


def hit_rules() -> dict[str, Column]:
    """What a hit must hold."""
    return {
        "rank_not_positive": F.coalesce(F.col("rank") > 0, F.lit(False)),
        "score_not_finite": F.coalesce(~F.isnan("bm25_score") & (F.abs("bm25_score") < float("inf")), F.lit(False)),
        "rerank_not_finite": F.coalesce(~F.isnan("rerank_score") & (F.abs("rerank_score") < float("inf")), F.lit(True)),
    }


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for every rule a row breaks; one pass, no shuffle."""
    broken = F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()])
    return df.select(F.col(key), F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("rule"))


def unexpected_columns(df: DataFrame, schema: StructType) -> list[str]:
    """Columns the closed schema does not know."""
    return sorted(set(df.columns) - set(schema.names))


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns in order, cast; unknown columns are refused, missing ones null."""
    if extra := unexpected_columns(df, schema):
        raise ValueError(f"unknown columns: {', '.join(extra)}")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Fails the query when a row breaks the condition, without an extra pass over the data."""
    return df.where(F.coalesce(F.assert_true(condition, F.lit(message)).isNull(), F.lit(True)))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
