"""Problem 5: how characteristic a term is of its record, by a parsimonious language model.

Background probabilities are term counts over the collection.  For each record,
expectation-maximisation separates the mass its own model needs from what the background
explains: terms common everywhere lose their mass, characteristic ones keep it.  The
converged probability is the score.  All records of an Arrow batch iterate together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import legal_tokens
from ..runtime import latest, stored, table
from .encode import _Shared

#: The background is broadcast up to this many terms and bytes, counted first; beyond, it is joined.
BROADCAST_TERMS, BROADCAST_BYTES = 1_000_000, 32 << 20
#: Weight of the record's own model; a record's rounds end when none of its probabilities moves by TOLERANCE or more.
OWN_WEIGHT, TOLERANCE = 0.1, 1e-5

SCHEMA = "chunk_id string, listed boolean, term string, tf int, df bigint, score double, place int"


def own_probabilities(record: np.ndarray, tf: np.ndarray, background: np.ndarray, weight: float = OWN_WEIGHT) -> np.ndarray:
    """Converged P(term | record); ``record`` is ascending, one entry per term of a record."""
    if not len(tf):
        return np.zeros(0)
    first = np.flatnonzero(np.r_[True, record[1:] != record[:-1]])
    each = np.diff(np.r_[first, len(tf)])
    tf = tf.astype(np.float64)
    p = tf / np.repeat(np.add.reduceat(tf, first), each)
    other = (1 - weight) * background
    # a record that has converged is frozen, so its rounds don't depend on the others
    out, active, at = p.copy(), np.ones(len(first), dtype=bool), np.arange(len(tf))
    while active.any():
        size = each[active]
        start = np.cumsum(size) - size
        e = tf[at] * (weight * p / (weight * p + other[at]))
        new = e / np.repeat(np.add.reduceat(e, start), size)
        still = np.maximum.reduceat(np.abs(new - p), start) >= TOLERANCE
        out[at] = new
        kept = np.repeat(still, size)
        p, at = new[kept], at[kept]
        active[active] = still
    return out


def _rows(ids: pa.Array, listed: pa.Array, record: np.ndarray, terms: pa.Array, order: np.ndarray, tf: np.ndarray, cf: np.ndarray, df: np.ndarray, total: float, least_tf: int, most_df: int | None) -> pa.RecordBatch:
    p = own_probabilities(record, tf, cf / total)
    by = np.lexsort((order, -np.round(p, 9), record))
    place = np.empty(len(p), dtype=np.int32)
    first = np.flatnonzero(np.r_[True, record[1:] != record[:-1]]) if len(p) else np.zeros(0, np.int64)
    place[by] = np.arange(len(p)) - np.repeat(first, np.diff(np.r_[first, len(p)])) + 1
    keep = tf >= least_tf
    if most_df is not None:
        keep &= df <= most_df
    at = pa.array(np.flatnonzero(keep))
    names = ["chunk_id", "listed", "term", "tf", "df", "score", "place"]
    whose = pa.array(record[keep])
    columns = [ids.take(whose), listed.take(whose), terms.take(at), pa.array(tf[keep].astype(np.int32)), pa.array(df[keep].astype(np.int64)), pa.array(p[keep]), pa.array(place[keep])]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """Record number of each entry, and the entries."""
    offsets = lists.offsets.to_numpy()
    return np.repeat(np.arange(len(lists)), np.diff(offsets)), lists.values.slice(offsets[0], offsets[-1] - offsets[0])


def characteristic(records: DataFrame, least_tf: int = 1, most_df: int | None = None, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """Operator: records (chunk_id, terms array<struct<term, tf>>, listed boolean) -> one row per term.

    ``score`` is the converged probability, ``place`` its rank in the record (ties by term),
    ``df`` the number of listed records with the term.  ``least_tf`` and ``most_df`` only
    choose which rows come out; every record and term takes part.  Null terms or counts
    below 1 are left out; records without terms give no rows.
    """
    clean = F.filter("terms", lambda x: x["term"].isNotNull() & (x["tf"] > 0))
    records = records.select("chunk_id", "listed", clean.alias("terms")).where(F.size("terms") > 0)
    counts = (
        records.select("listed", F.explode("terms").alias("t"))
        .groupBy(F.col("t.term").alias("term"))
        .agg(F.sum("t.tf").alias("cf"), F.count_if("listed").alias("df"))
    )
    counts = stored(counts)
    n, size, total = counts.agg(F.count(F.lit(1)), F.sum(F.octet_length("term") + 16), F.sum("cf")).first()
    if not n:
        return records.sparkSession.createDataFrame([], SCHEMA)
    if n <= broadcast_terms and size <= BROADCAST_BYTES:
        return _with_broadcast(records, counts, float(total), least_tf, most_df)
    return _with_join(records, counts, float(total), least_tf, most_df)


def _with_broadcast(records: DataFrame, counts: DataFrame, total: float, least_tf: int, most_df: int | None) -> DataFrame:
    t = counts.toArrow()
    t = t.take(pc.sort_indices(t["term"]))
    shared = _Shared(records.sparkSession.sparkContext.broadcast((t["term"].combine_chunks(), t["cf"].to_numpy(), t["df"].to_numpy())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, cf, df = shared.value
        for batch in batches:
            record, entries = _flat(batch.column(2))
            own = entries.field("term")
            at = pc.index_in(own, value_set=terms).to_numpy(zero_copy_only=False).astype(np.int64)
            yield _rows(batch.column(0), batch.column(1), record, own, at, entries.field("tf").to_numpy(), cf[at], df[at], total, least_tf, most_df)

    return records.select("chunk_id", "listed", "terms").mapInArrow(run, SCHEMA)


def _with_join(records: DataFrame, counts: DataFrame, total: float, least_tf: int, most_df: int | None) -> DataFrame:
    """Hot terms meet one row of ``counts`` each; AQE splits their side of the join."""
    flat = records.select("chunk_id", "listed", F.explode("terms").alias("t")).select("chunk_id", "listed", "t.term", "t.tf")
    lists = flat.join(counts, "term").groupBy("chunk_id", "listed").agg(F.sort_array(F.collect_list(F.struct("term", "tf", "cf", "df"))).alias("terms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            record, e = _flat(batch.column(2))
            get = lambda c: e.field(c).to_numpy()
            yield _rows(batch.column(0), batch.column(1), record, e.field("term"), np.arange(len(record)), get("tf"), get("cf"), get("df"), total, least_tf, most_df)

    return lists.mapInArrow(run, SCHEMA)


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Term lists of indexed_documents, each chunk once, and tokenised chunks whose list is missing."""
    lists = latest(table(spark, folder, "indexed_documents").select("chunk_id", F.col("term_frequencies").alias("terms")), ["chunk_id"], None)
    lists = stored(lists.where("terms is not null").select("chunk_id", F.lit(True).alias("listed"), "terms"))
    chunks = table(spark, folder, "legal_chunks").select("chunk_id", "retrieval_text").where("retrieval_text is not null")
    missing = latest(chunks.join(lists.select("chunk_id"), "chunk_id", "left_anti"), ["chunk_id"], None)
    counted = (
        missing.select("chunk_id", F.explode(legal_tokens(F.col("retrieval_text"))).alias("term"))
        .groupBy("chunk_id", "term")
        .agg(F.count(F.lit(1)).cast("int").alias("tf"))
        .groupBy("chunk_id")
        .agg(F.sort_array(F.collect_list(F.struct("term", "tf"))).alias("terms"))
    )
    return lists.unionByName(counted.select("chunk_id", F.lit(False).alias("listed"), "terms"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = characteristic(records(spark, folder), least_tf=3, most_df=3)
    return rows.where("listed").select("chunk_id", "term").distinct()


def p5_scores(spark: SparkSession, folder: str) -> DataFrame:
    return characteristic(records(spark, folder))
