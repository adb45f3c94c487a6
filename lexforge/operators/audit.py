"""Profiles and audits: lengths, duplicates, overlaps between splits, leaks of gold answers, fit."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dedup_key, legal_tokens, squeeze, strip
from ..runtime import blocks, stored

SPLITS = ("train", "warmup", "public", "private")
LOW_OVERLAP, PROMPT_EXTRA = 0.05, 32
#: Most bytes of needles broadcast at once by ``holders``; the longest hashed prefix; bits of its table.
HOLDER_BYTES, LONGEST_PREFIX, TABLE_BITS = 64 << 20, 64, 22


def length_stats(df: DataFrame, value: Column, *by: str) -> DataFrame:
    """Count, least, largest, mean and interpolated 50th, 90th and 95th percentile of a length."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), F.min(value).cast("bigint").alias("min"), F.max(value).cast("bigint").alias("max"), F.avg(value).alias("mean"),
        p[0].alias("p50"), p[1].alias("p90"), p[2].alias("p95"),
    )


def length_summary(df: DataFrame, value: Column, *by: str) -> DataFrame:
    """Least, mean (six decimals), nearest-rank 95th percentile, largest."""
    rows = df.withColumn("_v", value)
    return rows.groupBy(*by).agg(
        F.min("_v").cast("bigint").alias("min"),
        F.round(F.avg("_v"), 6).alias("mean"),
        F.expr("percentile_disc(0.95) within group (order by _v)").cast("bigint").alias("p95"),
        F.max("_v").cast("bigint").alias("max"),
    )


def question_profile(questions: DataFrame) -> DataFrame:
    """Counts of rows, distinct and repeated ids, blank questions, missing and blank answers."""
    blank = lambda c: F.col(c).isNotNull() & ~F.col(c).rlike(r"(?U)[^\s]")
    return questions.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"),
        (F.count(F.lit(1)) - F.count_distinct("id")).alias("n_repeated"),
        F.count_if(F.col("question").isNull() | blank("question")).alias("n_blank_questions"),
        F.count_if(F.col("answer").isNull()).alias("n_missing_answers"), F.count_if(blank("answer")).alias("n_blank_answers"),
    )


def duplicate_groups(questions: DataFrame, *by: str) -> DataFrame:
    """Numbers of groups with more than one row: equal questions, equal normal questions, and with equal answers.

    Each is a two-level count whose first level is partially aggregated.
    """
    normal = questions.withColumns({"_q": F.xxhash64("question"), "_n": F.xxhash64(dedup_key(F.col("question"))), "_a": F.xxhash64(strip(F.coalesce("answer", F.lit(""))))})

    def groups(name: str, *keys: str) -> DataFrame:
        per = normal.groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("c"))
        return per.groupBy(*by).agg(F.count_if(F.col("c") > 1).alias(name))

    parts = [groups("exact_groups", "_q"), groups("normal_groups", "_n"), groups("pair_groups", "_n", "_a")]
    if by:
        return reduce(lambda a, b: a.join(b, list(by)), parts)
    return reduce(lambda a, b: a.crossJoin(b), parts)  # one row each


def split_profile(questions: DataFrame) -> DataFrame:
    """Per split: rows, ids, blank and missing texts, interpolated length statistics of questions."""
    n = F.length("question")
    stats = length_stats(questions, n, "split")
    counts = questions.groupBy("split").agg(
        F.count_distinct("id").alias("n_ids"), F.count_if(F.col("answer").isNull()).alias("n_missing_answers"),
        F.count_if(~F.col("question").rlike(r"(?U)[^\s]")).alias("n_blank_questions"),
    )
    return stats.join(counts, stats["split"].eqNullSafe(counts["split"])).drop(counts["split"])


def split_overlaps(questions: DataFrame, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """(pair, n_ids, n_questions) for all pairs of splits: shared ids and shared normal questions.

    Every key is reduced to the set of splits it occurs in, so hot keys cost nothing; pairs
    without overlap come out with 0.
    """
    rows = questions.where(F.col("split").isin(*splits))

    def shared(key: Column, name: str) -> DataFrame:
        seen = rows.select(key.alias("k"), "split").groupBy("k").agg(*[F.max((F.col("split") == s).cast("int")).alias(s) for s in sorted(splits)])
        return seen.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias(f"{a}__{b}") for a, b in combinations(sorted(splits), 2)]).unpivot([], [f"{a}__{b}" for a, b in combinations(sorted(splits), 2)], "pair", name)

    return shared(F.col("id"), "n_ids").join(shared(F.xxhash64(dedup_key(F.col("question"))), "n_questions"), "pair")


def contains_text(hay: Column, needle: Column) -> Column:
    """Whether a text holds another as it is; blank needles are in nothing."""
    return F.coalesce(F.contains(hay, needle) & needle.rlike(r"(?U)[^\s]"), F.lit(False))


def contains_normal(hay: Column, needle: Column) -> Column:
    """The same for the normal forms of both."""
    return contains_text(dedup_key(hay), dedup_key(needle))


def _window_hashes(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(width, hashes of all windows of that width along the last axis) for the widths 1, 2, 4 up to the longest prefix."""
    width, h = 1, codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    while True:
        yield width, h
        if width == LONGEST_PREFIX or h.shape[-1] <= width:
            return
        h = h[..., :-width] * np.uint64(0xBF58476D1CE4E5B9) + h[..., width:]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        width *= 2


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Needles:
    """Literal search: a needle is found by the hash of its longest prefix of 1, 2, 4 ... characters, then compared."""

    def __init__(self, needles: list[str]):
        self.by_width: dict[int, tuple[np.ndarray, dict[int, list[tuple[int, str]]]]] = {}
        groups: dict[int, list[tuple[int, str]]] = {}
        for n, needle in enumerate(needles):
            groups.setdefault(min(1 << len(needle).bit_length() - 1, LONGEST_PREFIX), []).append((n, needle))
        for width, group in groups.items():
            prefixes = _codes("".join(needle[:width] for _, needle in group)).reshape(-1, width)
            *_, (_, h) = _window_hashes(prefixes)
            table, of = np.zeros(1 << TABLE_BITS, dtype=bool), {}
            table[h[:, 0] >> np.uint64(64 - TABLE_BITS)] = True
            for key, numbered in zip(h[:, 0].tolist(), group):
                of.setdefault(key, []).append(numbered)
            self.by_width[width] = table, of

    def search(self, texts: list[str]) -> Iterator[tuple[int, int]]:
        """Distinct (text number, needle number); a hit lies within one text."""
        joined = "".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        found: set[tuple[int, int]] = set()
        for width, h in _window_hashes(_codes(joined)):
            if width not in self.by_width:
                continue
            table, of = self.by_width[width]
            at = np.flatnonzero(table[h >> np.uint64(64 - TABLE_BITS)])
            rows = np.searchsorted(ends, at, side="right")
            for i, row, key in zip(at.tolist(), rows.tolist(), h[at].tolist()):
                for n, needle in of.get(key, ()):
                    if joined.startswith(needle, i) and i + len(needle) <= ends[row]:
                        found.add((row, n))
        return iter(found)


def holders(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(text_id, n_in_text, n_in_fields): every text (text_id, text, fields) that holds a non-blank needle (needle) literally.

    Counts distinct needles that stand in the text, and in any of the fields (array of
    strings).  Needles are broadcast in blocks of bounded bytes, each searched in every
    row in time linear in the texts; only rows with hits are shuffled.
    """
    spark = needles.sparkSession
    strings = stored(needles.where(F.col("needle").rlike(r"(?U)[^\s]")).select("needle").distinct())
    total = strings.agg(F.sum(F.octet_length("needle"))).first()[0] or 0
    n = blocks(total, HOLDER_BYTES / 2)
    texts = stored(texts.select("text_id", "text", "fields")) if n > 1 else texts.select("text_id", "text", "fields")
    found = []
    for part in range(n):
        block = strings.where(F.pmod(F.xxhash64("needle"), F.lit(n)) == part).toPandas()["needle"].tolist()
        shared = spark.sparkContext.broadcast(block)
        kind = texts.schema["text_id"].dataType.simpleString()
        found.append(texts.mapInArrow(_holder(shared), f"text_id {kind}, n_in_text bigint, n_in_fields bigint"))
    return reduce(DataFrame.union, found).groupBy("text_id").agg(F.sum("n_in_text").alias("n_in_text"), F.sum("n_in_fields").alias("n_in_fields"))


def _holder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = None
        for batch in batches:
            search = search or Needles(shared.value).search
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = np.zeros((len(texts), 2), dtype=np.int64)
            for row, _ in search(texts):
                counts[row, 0] += 1
            fields = [(row, f) for row, fs in enumerate(batch.column(2).to_pylist()) for f in fs or () if f]
            distinct = {f: k for k, f in enumerate(dict.fromkeys(f for _, f in fields))}
            inside: dict[int, set[int]] = {}
            for k, needle in search(list(distinct)):
                inside.setdefault(k, set()).add(needle)
            held: dict[int, set[int]] = {}
            for row, f in fields:
                if distinct[f] in inside:
                    held.setdefault(row, set()).update(inside[distinct[f]])
            for row, needles in held.items():
                counts[row, 1] = len(needles)
            rows = np.flatnonzero(counts.any(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(counts[rows, 0]), pa.array(counts[rows, 1])], names=["text_id", "n_in_text", "n_in_fields"])

    return run


def token_overlap(answer: Column, evidence: Column) -> Column:
    """Part of the answer's distinct legal tokens that the evidence holds; null without tokens."""
    a = F.array_distinct(legal_tokens(answer))
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, legal_tokens(evidence))) / F.size(a))


def case_support(cases: DataFrame) -> DataFrame:
    """(id, exact, normal, overlap) of the whole evidence and the flags of its first texts: cases (id, answer, evidence, top1, top3).

    Flags are null for empty answers, the overlap also for empty evidence; an answer
    without tokens overlaps with nothing.
    """
    given = F.col("answer") != ""
    flags = {f"{at}{name}": F.when(given, holds(F.col(text), F.col("answer"))) for at, text in (("", "evidence"), ("top1_", "top1"), ("top3_", "top3")) for name, holds in (("exact", contains_text), ("normal", contains_normal))}
    overlap = F.when(given & (F.col("evidence") != ""), F.coalesce(token_overlap(F.col("answer"), F.col("evidence")), F.lit(0.0)))
    return cases.select("id", *[c.alias(name) for name, c in flags.items()], overlap.alias("overlap"))


def case_documents(packed: DataFrame) -> DataFrame:
    """(id, document_ids): the distinct documents whose blocks are shown, sorted."""
    return packed.where(F.col("block").isNotNull()).groupBy("id").agg(F.array_sort(F.collect_set("document_id")).alias("document_ids"))


def fit_status(question: Column, answer: Column, prompt: Column, max_tokens: int = 4096) -> Column:
    """Whether question and answer, then prompt and answer, stay within the token limit."""
    n = lambda c: F.size(legal_tokens(F.coalesce(c, F.lit(""))))
    given = F.coalesce(answer.rlike(r"(?U)[^\s]"), F.lit(False))
    return (
        F.when(~given, "no_target").when(prompt.isNull(), "no_evidence")
        .when(n(question) + n(answer) + PROMPT_EXTRA > max_tokens, "TARGET_DOES_NOT_FIT")
        .when(n(prompt) + n(answer) <= max_tokens, "fits").otherwise("evidence_truncated_needed")
    )


def support_rates(cases: DataFrame) -> DataFrame:
    """Rates over cases (exact, normal, overlap, fit): null overlaps count as 0, null flags as false; fits over known ones."""
    flag = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double"))
    return cases.agg(
        F.count(F.lit(1)).alias("n_cases"), flag("exact").alias("exact_rate"), flag("normal").alias("normal_rate"),
        F.avg(F.coalesce("overlap", F.lit(0.0))).alias("mean_overlap"), F.avg((F.coalesce("overlap", F.lit(1.0)) < LOW_OVERLAP).cast("double")).alias("low_overlap_rate"),
        F.avg((F.col("fit") == "fits").cast("double")).alias("fit_rate"),
    )


def preview(text: Column, limit: int = 80) -> Column:
    return F.left(squeeze(text), F.lit(limit))
