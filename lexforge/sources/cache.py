"""Chunk caches: tables under the fingerprint of what they depend on, read as hit, miss or stale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..governance import digest, safe_cache
from ..operators.chunking import VERSION, summary
from ..schemas import CHUNK, conform

CACHE_VERSION = "lexforge.chunk-cache.1"


def cache_key(**depends) -> str:
    """Corpus digest, chunk limits and chunker version decide which cache is meant."""
    return digest({"schema_version": CACHE_VERSION, **depends})


def write_chunks(chunks: DataFrame, root: str, *, overwrite_stale: bool = False, **depends) -> str:
    """Writes the chunks, then what they are known by: a folder without that is no cache.

    A cache that is there is refused, unless it is stale and that is allowed to be replaced.
    """
    spark, key = chunks.sparkSession, cache_key(**depends)
    path = f"{safe_cache(root)}/{key}"
    status, reason, _ = read_chunks(spark, root, **depends)
    if status == "hit" or (status == "stale" and not overwrite_stale):
        raise FileExistsError(f"{path}: {status} {reason or ''}".strip())
    conform(chunks, CHUNK).repartition("document_id").sortWithinPartitions("document_id", "chunk_id").write.mode("overwrite").parquet(f"{path}/chunks")
    about = summary(spark.read.parquet(f"{path}/chunks")).withColumns(
        {"schema_version": F.lit(CACHE_VERSION), "cache_fingerprint": F.lit(key), "chunker_version": F.lit(depends.get("chunker_version", VERSION))}
    )
    about.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    return path


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as error:  # noqa: BLE001 - only a missing path means a miss
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return None


def read_chunks(spark: SparkSession, root: str, **depends) -> tuple[str, str | None, DataFrame | None]:
    """(status, reason, chunks): 'hit' with the chunks, 'miss', or 'stale' with what does not fit."""
    key = cache_key(**depends)
    path = f"{safe_cache(root)}/{key}"
    about, chunks = _read(spark, f"{path}/about"), _read(spark, f"{path}/chunks")
    if about is None:
        return ("miss", "cache_missing", None) if chunks is None else ("stale", "cache_incomplete", None)
    facts = about.first()
    if chunks is None or facts is None:
        return "stale", "cache_incomplete", None
    if facts["schema_version"] != CACHE_VERSION:
        return "stale", "unsupported_schema_version", None
    if facts["cache_fingerprint"] != key:
        return "stale", "cache_key_mismatch", None
    version = depends.get("chunker_version", VERSION)
    if chunks.where(~F.col("chunker_version").eqNullSafe(F.lit(version))).limit(1).count():
        return "stale", "chunker_version_mismatch", None
    if summary(chunks).first().asDict() != {k: facts[k] for k in ("n_chunks", "n_documents", "total_chars", "min_chars", "max_chars")}:
        return "stale", "summary_mismatch", None
    return "hit", None, chunks
