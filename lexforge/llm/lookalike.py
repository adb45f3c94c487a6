"""Problem 3: texts that look the same although their characters differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import stored, table
from .forms import consistent_form


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (kind, id, text) of questions and passages; null and blank texts left out."""
    q = table(spark, folder, "legal_questions").select(F.lit("question").alias("kind"), "id", F.col("question").alias("text"))
    d = table(spark, folder, "legal_documents").select(F.lit("document").alias("kind"), "id", F.col("passage").alias("text"))
    return q.unionByName(d).where(F.col("text").rlike(r"[^\s\x{A0}\x{2000}-\x{200F}\x{202F}\x{2060}\x{3000}\x{FEFF}]"))


def forms(items: DataFrame) -> DataFrame:
    """Operator: adds ``form``, the consistent form of ``text``, and ``skeleton``, its digest.

    Equal skeletons mean texts that look the same.  Null texts give null, empty ones the
    empty form; extra columns are kept.
    """
    return items.withColumn("form", consistent_form(F.col("text"))).withColumn("skeleton", F.sha2("form", 256))


def same_look(items: DataFrame) -> DataFrame:
    """Pairs (kind, id_a, id_b) of different ids with equal skeletons but different strings.

    A skeleton counts only if it covers two different strings; that test is a partially
    aggregated min/max, so a text copied a million times costs a row per task, and copies
    of one string never meet each other.
    """
    keyed = stored(forms(items).select("kind", "skeleton", F.xxhash64("text").alias("string"), "id"))
    varied = (
        keyed.groupBy("kind", "skeleton")
        .agg(F.min("string").alias("lo"), F.max("string").alias("hi"))
        .where("lo <> hi")
        .select("kind", "skeleton")
    )
    members = keyed.join(varied, ["kind", "skeleton"], "left_semi").distinct()
    a = members.select("kind", "skeleton", F.col("id").alias("id_a"), F.col("string").alias("string_a"))
    b = members.select("kind", "skeleton", F.col("id").alias("id_b"), F.col("string").alias("string_b"))
    return (
        a.join(b, ["kind", "skeleton"])
        .where("string_a <> string_b and id_a < id_b")
        .select("kind", "id_a", "id_b")
        .distinct()
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return same_look(texts(spark, folder))


def p3_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every text in its consistent form, whether it had to change, and the size of its look-alike group."""
    keyed = forms(texts(spark, folder).distinct())
    sizes = keyed.groupBy("kind", "skeleton").agg(F.count(F.lit(1)).alias("n_same_look"))
    return keyed.join(sizes, ["kind", "skeleton"]).select(
        "kind", "id", "form", (F.col("form") != F.col("text")).alias("changed"), "n_same_look"
    )
