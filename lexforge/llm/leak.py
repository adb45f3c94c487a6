"""Problem 4: evaluation texts inside training text, by Wu-Manber search over words.

A run of ``min_words`` words of a test text holds one of its segments of m = ceil(min_words / 2)
words that start at multiples of m, so those segments are the patterns, all of length m.
A table of block shifts says how far the window may jump over text whose last block of
``BLOCK`` words cannot end a pattern; blocks with shift 0 select a bucket of patterns, which
are compared word by word and then widened to the longest common run.

Test texts are taken in blocks of bounded bytes; each block in turn is broadcast, searched in
every corpus row and given up again.  With several blocks the corpus is brought into its form
once.  Nothing of the corpus is shuffled but the rows that hold a hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import blocks, cut, stored, table
from .encode import _Shared
from .forms import consistent_form

BLOCK = 3
#: Most bytes of test text broadcast at once.
BLOCK_BYTES = 24 << 20
_TABLE_BITS = 22
_WORDS = re.compile(r"[^\W_]+").findall


def _mix(codes: np.ndarray) -> np.ndarray:
    """Slot of the block of BLOCK words that ends at each position (positions before it give 0)."""
    h = np.zeros(len(codes), dtype=np.uint64)
    for back in range(BLOCK):
        shifted = np.concatenate([np.zeros(min(back, len(codes)), np.uint64), codes[: max(0, len(codes) - back)]])
        h = h * np.uint64(0x9E3779B97F4A7C15) + shifted
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


def _codes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)


class WuManber:
    """Patterns of m words with their places in the test texts; finds common runs."""

    def __init__(self, ids: list[int], texts: list[str], min_words: int):
        self.min_words, self.m = min_words, max(BLOCK, (min_words + 1) // 2)
        if min_words < 2 * BLOCK - 1:
            raise ValueError(f"min_words must be at least {2 * BLOCK - 1}")
        self.ids, self.tests = ids, [_WORDS(t) for t in texts]
        m, largest = self.m, self.m - BLOCK + 1
        self.shift = np.full(1 << _TABLE_BITS, largest, dtype=np.uint8 if largest < 256 else np.int32)
        #: suffix block -> {pattern words -> places}
        self.buckets: dict[int, dict[tuple, list[tuple[int, int]]]] = {}
        for n, words in enumerate(self.tests):
            if len(words) < min_words:
                continue
            slots = _mix(_codes(words))
            for start in range(0, len(words) - m + 1, m):
                for end in range(start + BLOCK - 1, start + m):
                    s = slots[end]
                    self.shift[s] = min(self.shift[s], start + m - 1 - end)
                self.buckets.setdefault(int(slots[start + m - 1]), {}).setdefault(tuple(words[start : start + m]), []).append((n, start))

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int]]:
        """(row, test id, longest common run) of all texts; the windows of all rows move at once."""
        rows = [_WORDS(t) for t in texts]
        lengths = np.array([len(r) for r in rows], dtype=np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        slots = _mix(_codes([w for r in rows for w in r]))
        lane = np.flatnonzero(lengths >= self.min_words)
        at = starts[lane] + self.m - 1
        best: dict[tuple[int, int], int] = {}
        while len(lane):
            shift = self.shift[slots[at]].astype(np.int64)
            for i in np.flatnonzero(shift == 0):
                row = int(lane[i])
                self._confirm(row, rows[row], int(at[i] - starts[row]), int(slots[at[i]]), best)
            at = at + np.maximum(shift, 1)
            keep = at < ends[lane]
            lane, at = lane[keep], at[keep]
        for (row, n), run in best.items():
            yield row, self.ids[n], run

    def _confirm(self, row: int, words: list[str], end: int, slot: int, best: dict) -> None:
        m = self.m
        found = self.buckets.get(slot)
        if not found or end < m - 1:
            return
        for n, start in found.get(tuple(words[end - m + 1 : end + 1]), ()):
            test, left, right = self.tests[n], 0, 0
            i, j = end - m, start - 1
            while i - left >= 0 and j - left >= 0 and words[i - left] == test[j - left]:
                left += 1
            i, j = end + 1, start + m
            while i + right < len(words) and j + right < len(test) and words[i + right] == test[j + right]:
                right += 1
            run = left + m + right
            if run >= self.min_words and run > best.get((row, n), 0):
                best[row, n] = run


_built: dict[tuple, WuManber] = {}


def leaks(tests: DataFrame, corpus: DataFrame, min_words: int = 30, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Operator: tests (test_id, text), corpus (row_id, text) -> (test_id, row_id, run_words).

    Every pair of a test and a row with at least ``min_words`` consecutive words in common,
    words being taken from the consistent form in lower case.  Null, empty and shorter
    texts match nothing.  Equal test texts are searched once and expanded afterwards.
    """
    spark = tests.sparkSession
    form = tests.select("test_id", F.lower(consistent_form(F.col("text"))).alias("form")).where("form is not null")
    keyed = cut(form.withColumn("text_key", F.xxhash64("form")).distinct())
    distinct = keyed.groupBy("text_key").agg(F.max_by("form", "test_id").alias("form")).where(F.length("form") >= 2 * min_words - 1)
    total = distinct.agg(F.sum(F.octet_length("form"))).first()[0] or 0
    n_blocks = blocks(total, block_bytes / 2)
    rows = corpus.where(F.length("text") >= 2 * min_words - 1).select("row_id", F.lower(consistent_form(F.col("text"))).alias("form"))
    kind = corpus.schema["row_id"].dataType.simpleString()
    rows = stored(rows) if n_blocks > 1 else rows
    found = None
    for block in range(n_blocks):
        part = distinct.where(F.pmod(F.xxhash64("text_key"), F.lit(n_blocks)) == block).toPandas()
        sent = spark.sparkContext.broadcast((part["text_key"].tolist(), part["form"].tolist()))
        hits = rows.mapInArrow(_searcher(_Shared(sent), min_words), f"row_id {kind}, text_key bigint, run_words int")
        if n_blocks > 1:  # one block at a time is held by the driver and the executors
            hits = stored(hits)
            sent.destroy()
        found = hits if found is None else found.unionByName(hits)
    best = found.groupBy("row_id", "text_key").agg(F.max("run_words").alias("run_words"))
    return best.join(keyed.select("test_id", "text_key"), "text_key").select("test_id", "row_id", "run_words")


def _searcher(shared: _Shared, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (shared.id, min_words)
        if key not in _built:
            _built.clear()
            _built[key] = WuManber(*shared.value, min_words)
        search = _built[key].search
        for batch in batches:
            ids = batch.column(0)
            hits = list(search(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array([h[0] for h in hits], pa.int64())), pa.array([h[1] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.int32())],
                names=["row_id", "text_key", "run_words"],
            )

    return run


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    tests = (
        table(spark, folder, "legal_questions")
        .where("split <> 'train' and answer is not null")
        .select(F.col("id").alias("test_id"), F.col("answer").alias("text"))
    )
    corpus = table(spark, folder, "legal_chunks").select(F.col("chunk_id").alias("row_id"), F.col("retrieval_text").alias("text"))
    return tests, corpus


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    found = leaks(*_tables(spark, folder))
    return found.select(F.col("test_id").alias("question_id"), F.col("row_id").alias("chunk_id"))


def p4_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Per leaked question: the chunks that hold it and the longest run in words."""
    found = leaks(*_tables(spark, folder))
    return found.groupBy(F.col("test_id").alias("question_id")).agg(
        F.countDistinct("row_id").alias("n_chunks"), F.max("run_words").alias("longest_run")
    )
