"""The best texts for every query of a stated set by BM25 weights, exactly: packed blocks of texts, one pass of Python over each.

A join of query terms with postings has a row per query, common term and text, hundreds of
millions from some ten thousand queries.  Here a block of texts is an inverted index in
arrays, a query sums its slices, and a block returns its best texts only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from ..runtime import blocks, stored

#: Texts and asked tokens a block holds, whichever is reached first (beyond them by one Arrow batch).
BLOCK_TEXTS, BLOCK_TOKENS = 24_576, 6_000_000

#: Bytes of query terms that are held by the driver and each task at once.
QUERY_BYTES = 16 << 20

#: Terms behind this share of a query's largest possible score are only looked up in texts that may still be among the best.
COMMON_SHARE = 0.45

#: Scores are ranked at nine decimals; sums along other paths differ by far less than this.
SLACK = 1e-7


def best(queries: DataFrame, texts: DataFrame, top: int, k1: float, b: float, least_average: float = 0.0) -> DataFrame:
    """(id, key, tie, score) with score > 0, at nine decimals; a superset of each query's ``top`` by score, then tie.

    ``queries`` is (id, terms), where repeated terms count as often; ``texts`` is (key, tie,
    dl, terms), with repeated tokens, or with their numbers in a further column ``tfs``.
    """
    queries = stored(queries.where(F.size("terms") > 0))
    size = queries.agg(F.sum(F.aggregate("terms", F.lit(0).cast("bigint"), lambda s, x: s + F.octet_length(x) + 4))).first()[0] or 0
    n = blocks(size, QUERY_BYTES)
    if n > 1:
        texts = stored(texts)
    found = None
    for i in range(n):
        some = _block(queries.where(F.pmod(F.xxhash64("id"), F.lit(n)) == i) if n > 1 else queries, texts, top, k1, b, least_average)
        found = some if found is None else found.unionByName(some)
    return found


def _block(queries: DataFrame, texts: DataFrame, top: int, k1: float, b: float, least_average: float) -> DataFrame:
    """The same for queries that fit into memory."""
    spark = queries.sparkSession
    asked = queries.select("id", "terms").toArrow().combine_chunks()
    ids, lists = _one(asked["id"]), _one(asked["terms"])
    coded = _one(pc.list_flatten(lists)).dictionary_encode()
    vocabulary, parents = coded.dictionary, pc.list_parent_indices(lists).to_numpy()
    width = max(1, len(vocabulary))
    # a query's distinct terms and how often it has each
    pairs, times = np.unique(parents.astype(np.int64) * width + coded.indices.to_numpy(), return_counts=True)
    starts = np.searchsorted(pairs, np.arange(len(ids) + 1, dtype=np.int64) * width)
    words = spark.sparkContext.broadcast(vocabulary)

    kinds = {f.name: f.dataType for f in texts.schema}
    binary = ("dls", "starts", "docs", "tfs")
    form = StructType([StructField("n", LongType()), StructField("total", LongType()), StructField("keys", ArrayType(kinds["key"])), StructField("ties", ArrayType(kinds["tie"])), *[StructField(c, BinaryType()) for c in binary]])
    packed = stored(texts.mapInArrow(_packer(words, BLOCK_TEXTS, BLOCK_TOKENS), form), tidy=True)
    words.destroy()

    sizes = packed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    counts = packed.select("starts").mapInArrow(_counts, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(vocabulary))
    df[counts["term"].to_numpy()] = counts["df"].to_numpy()
    weight = np.log(1.0 + (sizes[0] - df + 0.5) / (df + 0.5))
    average = max(sizes[1] / sizes[0] if sizes[0] else 0.0, least_average) or 1.0

    shared = spark.sparkContext.broadcast((ids, starts, (pairs % width).astype(np.int32), times.astype(np.float64), weight))
    out = StructType([StructField("id", queries.schema["id"].dataType), StructField("key", kinds["key"]), StructField("tie", kinds["tie"]), StructField("score", DoubleType())])
    found = stored(packed.select("keys", "ties", *binary).mapInArrow(_scorer(shared, average, top, k1, b), out))
    shared.destroy()
    return found


def _one(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    if not isinstance(column, pa.ChunkedArray):
        return column
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _packer(words, most_texts: int, most_tokens: int):
    """Texts to one row per block: keys in order of tie, lengths, and the postings of asked terms by term, then text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = words.value
        held: list[tuple] = []
        rows = tokens = 0
        for batch in batches:
            lists = batch.column("terms")
            at = pc.index_in(pc.list_flatten(lists), value_set=vocabulary)
            asked = at.is_valid().to_numpy(zero_copy_only=False)
            term = at.fill_null(0).to_numpy()[asked]
            text = pc.list_parent_indices(lists).to_numpy()[asked].astype(np.int64) + rows
            often = pc.list_flatten(batch.column("tfs")).to_numpy()[asked].astype(np.int64) if "tfs" in batch.schema.names else np.ones(len(term), np.int64)
            held.append((batch.column("key"), batch.column("tie"), batch.column("dl").to_numpy().astype(np.int64), term, text, often))
            rows, tokens = rows + batch.num_rows, tokens + len(term)
            if rows >= most_texts or tokens >= most_tokens:
                yield _packed(held, len(vocabulary))
                held, rows, tokens = [], 0, 0
        if rows:
            yield _packed(held, len(vocabulary))

    return run


def _packed(held: list[tuple], n_terms: int) -> pa.RecordBatch:
    keys, ties = (pa.concat_arrays([h[i] for h in held]) for i in (0, 1))
    dl, term, text, often = (np.concatenate([h[i] for h in held]) for i in (2, 3, 4, 5))
    n, order = len(keys), pc.sort_indices(ties).to_numpy()  # strings by code point
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    at = term.astype(np.int64) * n + place[text]
    by = np.argsort(at, kind="stable")
    at, first = np.unique(at[by], return_index=True)
    tf = np.add.reduceat(often[by], first) if len(first) else often
    starts = np.searchsorted(at, np.arange(n_terms + 1, dtype=np.int64) * n)
    blobs = [dl[order].astype("<i8"), starts.astype("<i4"), (at % n).astype("<i4"), tf.astype("<i4")]
    whole = lambda a: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), a.take(order))
    columns = [pa.array([n], pa.int64()), pa.array([int(dl.sum())], pa.int64()), whole(keys), whole(ties), *[pa.array([x.tobytes()], pa.binary()) for x in blobs]]
    return pa.RecordBatch.from_arrays(columns, names=["n", "total", "keys", "ties", "dls", "starts", "docs", "tfs"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts per asked term, over the blocks of a task."""
    total = None
    for batch in batches:
        for x in batch.column("starts"):
            df = np.diff(np.frombuffer(x.as_buffer(), "<i4")).astype(np.int64)
            total = df if total is None else total + df
    if total is not None:
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "df"])


def _scorer(shared, average: float, top: int, k1: float, b: float):
    """Blocks to the best texts of each query; what an earlier block of the task has already beaten is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, starts, terms, times, weight = shared.value
        floor = np.zeros(len(ids))
        for batch in batches:
            for i in range(batch.num_rows):
                keys, ties = (batch.column(c)[i].values for c in ("keys", "ties"))
                dls, at, docs, tfs = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("dls", "<i8"), ("starts", "<i4"), ("docs", "<i4"), ("tfs", "<i4")))
                tf = tfs.astype(np.float64)
                w = np.repeat(weight, np.diff(at)) * (tf * (k1 + 1.0) / (tf + (k1 * ((1.0 - b) + b * dls / average))[docs]))
                most, some = np.zeros(len(weight)), np.flatnonzero(np.diff(at))
                if not len(some):
                    continue
                most[some] = np.maximum.reduceat(w, at[some])
                who, where, scores = [], [], []
                for q in range(len(ids)):
                    own = slice(starts[q], starts[q + 1])
                    got, score = _best_of(terms[own], times[own], at, docs, w, most, len(dls), floor[q], top)
                    if len(got):
                        if len(got) == top:
                            floor[q] = max(floor[q], score[-1])
                        who.append(np.full(len(got), q))
                        where.append(got)
                        scores.append(score)
                if who:
                    place = pa.array(np.concatenate(where))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(who))), keys.take(place), ties.take(place), pa.array(np.concatenate(scores))], names=["id", "key", "tie", "score"])

    return run


def _best_of(terms: np.ndarray, times: np.ndarray, at: np.ndarray, docs: np.ndarray, w: np.ndarray, most: np.ndarray, n: int, floor: float, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a block, at most ``top``, with their scores, best first.

    The terms that can give most are summed over all texts.  A text that would not reach the
    ``top``-th of these sums even with all that the other terms can give is not among the best;
    in the others these are looked up.
    """
    limit = times * most[terms]
    order = np.argsort(-limit, kind="stable")
    order = order[limit[order] > 0]
    terms, times, limit = terms[order], times[order], limit[order]
    rest = limit.sum() - np.cumsum(limit)
    if not len(terms) or rest[0] + limit[0] < floor - SLACK:
        return np.empty(0, np.int64), np.empty(0)
    head = int(np.argmax(rest <= max(COMMON_SHARE * (rest[0] + limit[0]), floor - SLACK))) + 1
    lows, highs = at[terms].tolist(), at[terms + 1].tolist()
    total = _summed(docs, w, lows[:head], highs[:head], times, n)
    behind = rest[head - 1] if head < len(terms) else 0.0
    reached = max(floor, float(np.partition(total, n - top)[n - top]) if n > top else 0.0)
    cut = reached - behind - SLACK
    if head < len(terms):
        left = np.flatnonzero(total >= cut) if cut > 0 else None
        if left is not None and 24 * len(left) * (len(terms) - head) < sum(highs[head:]) - sum(lows[head:]) + 4 * n:
            score = total[left]
            for low, high, m in zip(lows[head:], highs[head:], times[head:]):
                part = docs[low:high]
                place = np.searchsorted(part, left)
                place[place == len(part)] = 0
                score += np.where(part[place] == left, m * w[low + place], 0.0)
        else:
            total += _summed(docs, w, lows[head:], highs[head:], times[head:], n)
            reached = max(floor, float(np.partition(total, n - top)[n - top]) if n > top else 0.0)
            left = np.flatnonzero(total >= max(reached - SLACK, 0.0))
            score = total[left]
    else:
        left = np.flatnonzero(total >= max(cut, 0.0))
        score = total[left]
    score = np.round(score, 9)
    kept = (score > 0) & (score >= floor)
    left, score = left[kept], score[kept]
    if len(left) > top:
        kept = score >= np.partition(score, len(score) - top)[len(score) - top]
        left, score = left[kept], score[kept]
    order = np.argsort(-score, kind="stable")[:top]  # texts stand in order of tie
    return left[order], score[order]


def _summed(docs: np.ndarray, w: np.ndarray, lows: list[int], highs: list[int], times: np.ndarray, n: int) -> np.ndarray:
    where = np.concatenate([docs[a:z] for a, z in zip(lows, highs)])
    return np.bincount(where, weights=np.concatenate([w[a:z] if m == 1.0 else m * w[a:z] for a, z, m in zip(lows, highs, times)]), minlength=n)
