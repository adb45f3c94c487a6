"""Problem 9: mixing sources to target shares of tokens, with a low-discrepancy schedule.

The size of the mixture is the largest at which no source needs more than its repeats.
Each pass over a source is a stream of its documents in hashed order, cut into blocks of
equal tokens.  Slot i of the schedule takes the point frac((i + 1/2) / golden ratio), looks
its source up in the cumulative weights, and takes that source's next block: at any prefix
the sources stand close to their shares.  Running sums and ranks are taken in two levels
(within bounded buckets, then over bucket totals), so no source meets in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import small, stored, table
from .encode import TOKENIZERS, token_counts

BLOCK_TOKENS = 2048
BUCKET_DOCS = 20_000
SLOT_RANGE = 50_000
#: Cells of the unit interval in which sources are looked up.
CELLS = 1024
#: Most sources a mixture may name; their table is held by the driver and broadcast.
MOST_SOURCES = 10_000
GOLDEN = (math.sqrt(5) - 1) / 2


def plan(sources: list[tuple[str, float, int, int]]) -> float:
    """Tokens of the largest mixture; sources are (name, share, repeats, tokens), absent ones with 0 tokens."""
    sizes = [tokens * repeats / share for _, share, repeats, tokens in sources if share > 0 and tokens > 0 and repeats > 0]
    return min(sizes) if sizes else 0.0


def _schedule(spark: SparkSession, shares: list[tuple[str, float]], slots: int) -> DataFrame:
    """(slot, source, block): block is the rank of the slot among those of its source."""
    total, edges, upto = sum(s for _, s in shares), [], 0.0
    for name, share in shares:
        upto += share / total
        edges.append((name, upto))
    u = (F.col("id") + 0.5) * GOLDEN
    u = u - F.floor(u)
    # each source is looked up among those that reach into the point's cell: at most CELLS rows more than sources
    lows = [0.0, *[edge for _, edge in edges[:-1]]]
    highs = [*[edge for _, edge in edges[:-1]], 1.0]
    reach = [(cell, name, lo, hi) for (name, _), lo, hi in zip(edges, lows, highs) if lo < hi for cell in range(int(lo * CELLS), min(CELLS - 1, int(hi * CELLS)) + 1)]
    of = F.broadcast(spark.createDataFrame(reach, "cell int, source string, lo double, hi double"))
    points = spark.range(slots).select(F.col("id").alias("slot"), u.alias("u"), F.floor(F.col("id") / SLOT_RANGE).alias("stretch")).withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
    s = points.join(of, "cell").where("u >= lo and u < hi").select("slot", "source", "stretch")
    before = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = s.groupBy("source", "stretch").agg(F.count(F.lit(1)).alias("n")).select("source", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("source", "stretch").orderBy("slot")) - 1
    return s.withColumn("r", rank).join(small(starts, len(shares) * math.ceil(slots / SLOT_RANGE)), ["source", "stretch"]).select("slot", "source", (F.col("start") + F.col("r")).alias("block"))


def mixture(sized: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Operator: sized (doc_id, source, n_tokens), targets (source, target_share, max_repeats) -> (mix, report).

    mix has (slot, place, source, doc_id, pass, n_tokens): documents in the order of the
    mixture.  Documents without tokens and sources without a target are left out; a target
    source without documents is reported with share 0.  Of repeated targets of a source the
    largest counts; more than MOST_SOURCES sources are refused.
    """
    spark = sized.sparkSession
    sized = stored(sized.where("n_tokens > 0 and source is not null"))
    goals = [(r["source"], float(r["target_share"]), int(r["max_repeats"])) for r in targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).orderBy("source").limit(MOST_SOURCES + 1).collect()]
    if len(goals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources have a target")
    names = spark.createDataFrame([(s,) for s, _, _ in goals], "source string")
    have = {r["source"]: (r["n"], r["t"]) for r in sized.join(F.broadcast(names), "source", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).collect()}
    full = [(s, share, k, have.get(s, (0, 0))[1]) for s, share, k in goals]
    total = plan(full)
    usable = [(s, share, k, t) for s, share, k, t in full if t > 0 and k > 0]
    slots = math.ceil(total * sum(share for _, share, _, _ in usable) / block_tokens) if usable else 0
    schema = "slot bigint, place int, source string, doc_id bigint, pass int, n_tokens bigint"
    if not slots:
        mix = spark.createDataFrame([], schema)
    else:
        mix = _take(spark, sized, usable, {s: n for s, (n, _) in have.items()}, slots, total, block_tokens, seed)
    used = mix.groupBy("source").agg(F.sum("n_tokens").alias("tokens_used"), F.count(F.lit(1)).alias("docs_used"), F.max(F.col("pass") + 1).alias("most_uses"))
    available = spark.createDataFrame([(s, share, k, have.get(s, (0, 0))[0], have.get(s, (0, 0))[1]) for s, share, k in goals], "source string, target_share double, max_repeats int, docs_available bigint, tokens_available bigint")
    joined = available.join(used, "source", "left").fillna(0, ["tokens_used", "docs_used", "most_uses"])
    whole = mix.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("whole"))
    report = joined.crossJoin(F.broadcast(whole)).select(
        "source", "target_share", F.when(F.col("whole") > 0, F.col("tokens_used") / F.col("whole")).otherwise(F.lit(0.0)).alias("actual_share"),
        "max_repeats", "most_uses", "docs_available", "docs_used", "tokens_available", "tokens_used",
    )
    return mix, report


def _take(spark: SparkSession, sized: DataFrame, usable: list, docs: dict, slots: int, total: float, block_tokens: int, seed: int) -> DataFrame:
    weight = sum(share for _, share, _, _ in usable)
    rows = []
    for s, share, k, tokens in usable:
        quota = slots * block_tokens * share / weight + 8 * block_tokens
        rows.append((s, min(k, math.ceil(quota / tokens)), max(1, math.ceil(docs[s] / BUCKET_DOCS)), tokens))
    per = F.broadcast(spark.createDataFrame(rows, "source string, passes int, buckets bigint, tokens bigint"))  # one row per target
    copies = sized.join(per, "source").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    copies = copies.withColumn("h", F.xxhash64("doc_id", "pass", F.lit(seed))).withColumn("bucket", F.pmod(F.shiftright("h", 20), F.col("buckets")))
    keys = ["source", "pass", "bucket"]
    ahead = Window.partitionBy("source", "pass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = copies.groupBy(*keys).agg(F.sum("n_tokens").alias("n")).select(*keys, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*keys).orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    copies = copies.withColumn("own", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    n_starts = sum(r[1] * r[2] for r in rows)
    copies = copies.join(small(starts, n_starts), keys).withColumn("at", F.col("pass") * F.col("tokens") + F.col("start") + F.col("own"))
    copies = copies.withColumn("block", F.floor(F.col("at") / block_tokens).cast("bigint"))
    joined = copies.join(_schedule(spark, [(s, share) for s, share, _, _ in usable], slots), ["source", "block"])
    place = F.row_number().over(Window.partitionBy("slot").orderBy("at", "doc_id")) - 1
    return joined.select("slot", place.alias("place"), "source", "doc_id", "pass", "n_tokens")


def _sized(spark: SparkSession, folder: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), "doc_id", "text", ["source"], folder=tokenizers)


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture itself: every document copy with its slot."""
    return mixture(_sized(spark, folder), table(spark, folder, "mix_targets"))[0]


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixture(_sized(spark, folder), table(spark, folder, "mix_targets"))[1]
