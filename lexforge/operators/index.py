"""Inverted index as tables: postings, document frequencies, lengths, statistics; and its stored form."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import legal_tokens

INDEX_VERSION = "lexforge.index.1"


@dataclass(frozen=True)
class Index:
    """postings (chunk_id, term, tf), lengths (chunk_id, dl), df (term, df), stats (one row).

    An index that was built has its texts (chunk_id, dl, terms) as well, with repeated terms.
    """

    postings: DataFrame
    lengths: DataFrame
    df: DataFrame
    stats: DataFrame
    texts: DataFrame | None = None


def tokens(chunks: DataFrame, text: str = "retrieval_text") -> DataFrame:
    """(chunk_id, pos, term): one row per token, in order from 0."""
    return chunks.select("chunk_id", F.posexplode(legal_tokens(F.col(text))).alias("pos", "term"))


def postings(chunks: DataFrame, text: str = "retrieval_text") -> DataFrame:
    """Term frequencies per chunk.  Duplicate chunk ids count as one chunk: pass distinct rows."""
    return (
        chunks.select("chunk_id", F.explode(legal_tokens(F.col(text))).alias("term"))
        .groupBy("chunk_id", "term")
        .agg(F.count(F.lit(1)).cast("int").alias("tf"))
    )


def build(chunks: DataFrame, text: str = "retrieval_text") -> Index:
    """Index of (chunk_id, text).  Chunks without tokens count in the statistics with length 0."""
    p = postings(chunks, text)
    texts = chunks.select("chunk_id", legal_tokens(F.col(text)).alias("terms"))
    texts = texts.select("chunk_id", F.coalesce(F.greatest(F.size("terms"), F.lit(0)), F.lit(0)).alias("dl"), "terms")
    index = from_postings(p, texts.select("chunk_id", "dl"))
    return Index(index.postings, index.lengths, index.df, index.stats, texts)


def bags(index: Index) -> DataFrame:
    """(chunk_id, dl, terms) of all chunks; of a stored index, whose texts are gone, each term once and its numbers as ``tfs``."""
    if index.texts is not None:
        return index.texts
    lists = index.postings.groupBy("chunk_id").agg(F.collect_list(F.struct("term", "tf")).alias("l"))
    return index.lengths.join(lists, "chunk_id", "left").select("chunk_id", "dl", F.col("l")["term"].alias("terms"), F.col("l")["tf"].alias("tfs"))


def from_postings(p: DataFrame, lengths: DataFrame) -> Index:
    df = p.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    size = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_tokens"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_dl"))
    stats = size.crossJoin(df.agg(F.count(F.lit(1)).alias("vocabulary")))  # one row each
    return Index(p, lengths, df, stats)


def fingerprint(**config) -> str:
    """SHA-256 of the configuration as sorted, compact JSON."""
    text = json.dumps(config, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


def store(index: Index, folder: str, *, overwrite: bool = False, **config) -> str:
    """Writes the tables under a folder named by the fingerprint; an existing one is kept unless told.

    What a broken-off write left behind is no index and is written over.
    """
    key = fingerprint(version=INDEX_VERSION, **config)
    path = f"{folder}/{key}"
    if not overwrite and load(index.postings.sparkSession, folder, **config)[1] != "index_missing":
        raise FileExistsError(path)
    mode = "overwrite"
    index.postings.repartition("term").sortWithinPartitions("term", "chunk_id").write.mode(mode).parquet(f"{path}/postings")
    index.lengths.write.mode(mode).parquet(f"{path}/lengths")
    index.df.write.mode(mode).parquet(f"{path}/df")
    # statistics come last: a folder without them is no index, and may be written over
    index.stats.withColumn("fingerprint", F.lit(key)).withColumn("version", F.lit(INDEX_VERSION)).coalesce(1).write.mode(mode).parquet(f"{path}/stats")
    return path


def load(spark: SparkSession, folder: str, **config) -> tuple[Index | None, str]:
    """(index, status): 'hit', or no index with 'index_missing', 'index_key_mismatch' or 'index_inconsistent'."""
    key = fingerprint(version=INDEX_VERSION, **config)
    path = f"{folder}/{key}"
    try:
        stats = spark.read.parquet(f"{path}/stats")
    except Exception as error:  # noqa: BLE001 - only a missing path means a miss
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None, "index_missing"
    if stats.where(F.col("fingerprint") != key).limit(1).count():
        return None, "index_key_mismatch"
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    facts = stats.first()
    if read("lengths").agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first() != (facts["n_docs"], facts["total_tokens"]) or read("df").count() != facts["vocabulary"]:
        return None, "index_inconsistent"
    return Index(read("postings"), read("lengths"), read("df"), stats.drop("fingerprint", "version")), "hit"


def inconsistent(indexed: DataFrame) -> DataFrame:
    """Chunks of (chunk_id, term_frequencies, document_length) whose length is not the sum of their counts."""
    total = F.aggregate("term_frequencies", F.lit(0), lambda a, x: a + x["tf"])
    return indexed.where("term_frequencies is not null").where(total != F.col("document_length")).select(
        "chunk_id", "document_length", total.alias("counted")
    )
