"""Rerankers: DataFrame functions from hits to hits, all ranked by score, then chunk id."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import blocks

#: Most query vectors broadcast at once.
QUERY_BLOCK = 4_000

Reranker = Callable[[DataFrame], DataFrame]


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; a zero vector gives 0, unequal sizes an error."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors of unequal size")))


def _rerank(hits: DataFrame, score: Column) -> DataFrame:
    scored = hits.withColumn("rerank_score", F.round(score, 9))
    order = Window.partitionBy("id").orderBy(F.desc("rerank_score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order))


def noop(hits: DataFrame, reason: str = "reranking_disabled") -> DataFrame:
    """Unchanged; ``used`` is false, with the reason, and there is no rerank score."""
    return hits.withColumns({"rerank_score": F.lit(None).cast("double"), "used": F.lit(False), "fallback_reason": F.lit(reason)})


def mock(hits: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Scores (chunk_id, score) from a table, 1 / rank where it has none."""
    default = F.lit(1.0) / F.col("rank")
    shown = {"used": F.lit(True), "fallback_reason": F.lit(None).cast("string")}
    if scores is None:
        return _rerank(hits, default).withColumns(shown)
    given = scores.select("chunk_id", F.col("score").alias("_given"))
    return _rerank(hits.join(given, "chunk_id", "left"), F.coalesce("_given", default)).drop("_given").withColumns(shown)


def by_vectors(hits: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Cosine of stored vectors: questions (id, vector), chunks (chunk_id, vector).

    A hit without a vector on either side falls back to its old order behind the scored
    ones, with the reason in ``fallback_reason``.
    """
    q = questions.select("id", F.col("vector").alias("_q"))
    c = chunks.select("chunk_id", F.col("vector").alias("_c"))
    both = hits.join(q, "id", "left").join(c, "chunk_id", "left")
    score = F.when(F.col("_q").isNotNull() & F.col("_c").isNotNull(), cosine(F.col("_q"), F.col("_c")))
    scored = both.withColumn("rerank_score", F.round(score, 9)).drop("_q", "_c")
    order = Window.partitionBy("id").orderBy(F.col("rerank_score").desc_nulls_last(), F.when(F.col("rerank_score").isNull(), F.col("rank")), "chunk_id")
    return scored.withColumns(
        {"used": F.col("rerank_score").isNotNull(), "fallback_reason": F.when(F.col("rerank_score").isNull(), F.lit("vector_missing"))}
    ).withColumn("rank", F.row_number().over(order))


def semantic(hits: DataFrame, questions: DataFrame, chunks: DataFrame, encoder: Callable[[], Callable[[list[str]], list[list[float]]]], max_chars: int = 2048) -> DataFrame:
    """Encodes the texts with ``encoder()`` (built once per worker, called per Arrow batch) and reranks.

    Every distinct text is encoded once, before the join with the hits; texts are cut to
    ``max_chars`` characters without trailing blanks.
    """

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = encoder()
        for frame in frames:
            texts = [t[:max_chars].rstrip() for t in frame["text"]]
            yield pd.DataFrame({"key": frame["key"], "vector": run(texts) if texts else []})

    q = questions.select(F.col("id").alias("key"), F.col("question").alias("text")).mapInPandas(encode, "key string, vector array<double>")
    wanted = chunks.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi")
    c = wanted.select(F.col("chunk_id").alias("key"), F.col("retrieval_text").alias("text")).mapInPandas(encode, "key string, vector array<double>")
    return by_vectors(hits, q.withColumnRenamed("key", "id"), c.withColumnRenamed("key", "chunk_id"))


def create(name: str, **options) -> Reranker:
    """The reranker of that name as a function of the hits."""
    known = {"none": noop, "noop": noop, "mock": mock, "vectors": by_vectors, "semantic": semantic}
    if name not in known:
        raise ValueError(f"unknown reranker {name!r}")
    return lambda hits: known[name](hits, **options)


def for_profile(name: str, model: str, questions: DataFrame, chunks: DataFrame) -> Reranker:
    """The reranker a profile names; a model that cannot be loaded leaves the order as it is, with the reason."""
    if name == "none":
        return noop
    if name == "mock":
        return create("mock")
    if name != "semantic":
        raise ValueError(f"unknown reranker {name!r}")
    try:
        import sentence_transformers  # noqa: F401
    except ImportError:
        return lambda hits: noop(hits, "reranker_unavailable")

    def encoder() -> Callable[[list[str]], list[list[float]]]:
        from sentence_transformers import SentenceTransformer

        loaded = SentenceTransformer(model)
        return lambda texts: loaded.encode(texts, normalize_embeddings=True).tolist()

    return lambda hits: semantic(hits, questions, chunks, encoder)


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 10) -> DataFrame:
    """(query_id, vec_id, rank, score): exact nearest vectors by cosine for a stated query set.

    The queries are a stated set against all rows: they are broadcast in size-checked
    blocks, and each block keeps only its best ``top`` per partition before the shuffle.
    """
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_q"))
    n = queries.count()
    parts = blocks(n, QUERY_BLOCK)
    q = q.withColumn("_part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    pieces = [vectors.crossJoin(F.broadcast(q.where(F.col("_part") == i).drop("_part"))) for i in range(parts)]
    pairs = reduce(DataFrame.union, pieces).where("vec_id <> query_id")
    scored = pairs.select("query_id", "vec_id", F.round(cosine(F.col("_q"), F.col("embedding")), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "vec_id", "rank", "score")


def status(hits: DataFrame, *by: str) -> DataFrame:
    """For each group whether reranking was used ('true', 'false', 'mixed', 'not_run') and the distinct reasons."""
    used = F.when(F.count("used") == 0, "not_run").when(F.bool_and("used"), "true").when(~F.bool_or("used"), "false").otherwise("mixed")
    return hits.groupBy(*by).agg(used.alias("used"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("fallback_reason")).alias("reasons"))
