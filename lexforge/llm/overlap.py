"""Problem 7: evaluation records that return in the training split, exactly or almost.

Evaluation texts are sharded, and an Aho-Corasick automaton over the pieces (word bigrams) of
a shard's texts scans the training texts that may belong to it.  Of each evaluation text the
rarest pieces of its shard propose it, as many as suffice: a text that shares the required
part of its bigrams shares one of any n - ceil(t * n) + 1 of them.  All hits on a proposed text
are merged as intervals into its coverage, and their number decides.

Because both texts must hold the same words with digits, the multiset of those words is the
shard key; a key with many rows is split into blocks of evaluation texts times salts of
training texts, so no task gets an unbounded group.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import blocks, stored, table
from .forms import consistent_form, words

#: Most texts of either side in one task's group.
GROUP_ROWS = 4_000


def _grams(tokens: list[str]) -> set[str]:
    return {f" {a} {b} " for a, b in zip(tokens, tokens[1:])}


def _coverage(tokens: list[str], shared: set[str]) -> float:
    """Part of the tokens inside the merged intervals of the matched pieces."""
    covered, upto = 0, 0
    for i, gram in enumerate(f" {a} {b} " for a, b in zip(tokens, tokens[1:])):
        if gram in shared:
            covered += i + 2 - max(i, upto)
            upto = i + 2
    return covered / len(tokens) if tokens else 0.0


_COLUMNS = ["train_key", "eval_key", "similarity", "coverage"]


def _match(threshold: float):
    def run(train: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        held = held.rename(columns=lambda c: c.removeprefix("held_"))
        if len(train) and len(held):
            grams = [_grams(f.split()) for f in held["form"]]
            often = Counter(g for gs in grams for g in gs)
            posting: dict[str, list[int]] = {}
            for n, gs in enumerate(grams):
                k = len(gs) - math.ceil(threshold * len(gs) - 1e-9) + 1 if gs else 0
                for g in sorted(gs, key=lambda g: (often[g], g))[:k]:
                    posting.setdefault(g, []).append(n)
            equal: dict[tuple, list[int]] = {}
            for n, (f, sig) in enumerate(zip(held["form"], held["digits"])):
                equal.setdefault((f, sig), []).append(n)
            machine = ahocorasick.Automaton()
            for g in often:
                machine.add_word(g, g)
            if often:
                machine.make_automaton()
            held_sig, held_key, held_form = held["digits"].tolist(), held["text_key"].tolist(), held["form"].tolist()
            for key, form, sig in zip(train["text_key"], train["form"], train["digits"]):
                near = set(equal.get((form, sig), ()))
                hits = {g for _, g in machine.iter(f" {form} ")} if often else set()
                for g in hits:
                    near.update(posting.get(g, ()))
                own = None
                for n in near:
                    if held_sig[n] != sig:
                        continue
                    own = len(_grams(form.split())) if own is None else own
                    both = hits & grams[n]
                    either = own + len(grams[n]) - len(both)
                    score = len(both) / either if either else float(form == held_form[n])
                    if score >= threshold - 1e-12:
                        out.append((key, held_key[n], score, _coverage(held_form[n].split(), both)))
        return pd.DataFrame(out, columns=_COLUMNS).astype({"train_key": "int64", "eval_key": "int64", "similarity": "float64", "coverage": "float64"})

    return run


def overlaps(records: DataFrame, threshold: float = 0.75, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Operator: records (id, split, text) -> (train_id, eval_id, similarity, coverage).

    Pairs of a train record and a held-out one whose texts share ``threshold`` of their word
    bigrams and hold the same words with digits, equally often.  Texts without words match
    nothing; texts of one word match equal ones.  Null splits belong to neither side.
    Equal texts are compared once and expanded at the end.
    """
    form = records.where("text is not null and split is not null").select(
        "id", (F.col("split") == "train").alias("train"), words(consistent_form(F.col("text"))).alias("w")
    ).where("size(w) > 0")
    sig = F.array_sort(F.filter("w", lambda x: x.rlike(r"\p{N}")))
    form = form.select("id", "train", F.array_join("w", " ").alias("form"), F.array_join(sig, " ").alias("digits"))
    members = stored(form.withColumn("text_key", F.xxhash64("form")).distinct())
    texts = members.groupBy("text_key", "train").agg(F.max_by(F.struct("form", "digits"), "id").alias("t")).select("text_key", "train", "t.form", "t.digits")
    texts = stored(texts)
    sizes = texts.groupBy("digits").agg(F.sum(F.col("train").cast("int")).alias("n_train"), F.sum((~F.col("train")).cast("int")).alias("n_eval")).where("n_train > 0 and n_eval > 0")
    n_train = texts.where("train").count()
    shards = blocks(n_train, group_rows / 4)
    big = (F.col("n_train") > group_rows) | (F.col("n_eval") > group_rows)
    sizes = sizes.select(
        "digits",
        F.when(big, F.xxhash64("digits")).otherwise(F.pmod(F.xxhash64("digits"), F.lit(shards))).alias("shard"),
        F.when(big, F.ceil(F.col("n_train") / group_rows)).otherwise(F.lit(1)).cast("int").alias("salts"),
        F.when(big, F.ceil(F.col("n_eval") / group_rows)).otherwise(F.lit(1)).cast("int").alias("parts"),
    )
    placed = texts.join(sizes, "digits")
    own = lambda n: F.pmod(F.xxhash64("text_key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["shard", "part", "salt", "text_key", "form", "digits"]
    train = placed.where("train").withColumn("salt", own("salts")).withColumn("part", every("parts")).select(columns)
    held = placed.where("not train").withColumn("part", own("parts")).withColumn("salt", every("salts")).select(columns)
    held = held.select(*[F.col(c).alias(f"held_{c}") for c in columns])
    keys = ["shard", "part", "salt"]
    pairs = train.groupBy(*keys).cogroup(held.groupBy(*[f"held_{k}" for k in keys])).applyInPandas(_match(threshold), "train_key bigint, eval_key bigint, similarity double, coverage double")
    a = members.where("train").select(F.col("text_key").alias("train_key"), F.col("id").alias("train_id"))
    b = members.where("not train").select(F.col("text_key").alias("eval_key"), F.col("id").alias("eval_id"))
    return pairs.join(a, "train_key").join(b, "eval_key").select("train_id", "eval_id", "similarity", "coverage")


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "legal_questions").select("id", "split", F.col("question").alias("text"), "source")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    found = overlaps(_records(spark, folder)).where("train_id <> eval_id")
    return found.select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b")).distinct()


def p7_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Per held-out record that returns in train: its train records, the most similar, and how much of it one of them covers."""
    held = _records(spark, folder).where("split is not null and split <> 'train'").select(F.col("id").alias("eval_id"), "split", "source").distinct()
    found = overlaps(_records(spark, folder)).where("train_id <> eval_id")
    per = found.groupBy("eval_id").agg(F.count_distinct("train_id").alias("n_train"), F.max("similarity").alias("similarity"), F.max("coverage").alias("coverage"))
    return held.join(per, "eval_id")


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per held-out split and source: records, records that return in train, train records behind them."""
    held = _records(spark, folder).where("split is not null and split <> 'train'").select(F.col("id").alias("eval_id"), "split", "source").distinct()
    found = overlaps(_records(spark, folder)).where("train_id <> eval_id")
    per = found.groupBy("eval_id").agg(F.count(F.lit(1)).alias("n_train"), F.max("similarity").alias("best"))
    return (
        held.join(per, "eval_id", "left")
        .groupBy("split", "source")
        .agg(
            F.count(F.lit(1)).alias("n_records"),
            F.count("n_train").alias("n_overlapping"),
            F.coalesce(F.sum("n_train"), F.lit(0)).cast("bigint").alias("n_pairs"),
            F.count_if(F.col("best") >= 1).alias("n_exact"),
        )
    )
