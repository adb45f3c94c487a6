"""Few-shot answering: a question set, fixed examples, optional evidence, and the scores by reference."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, prompting
from ..runtime import stored


def load(spark: SparkSession, path: str) -> DataFrame:
    """(id, question, evidence, answer) of a JSON list keyed by ``question_id``, or of a map by id; ids stay text."""
    with open(path, encoding="utf-8") as file:
        value = json.load(file)
    items = [(str(r["question_id"]), r) for r in value] if isinstance(value, list) else [(str(k), r) for k, r in value.items()]
    rows = [(i, r.get("question"), r.get("evidence"), r.get("answer")) for i, r in items]
    if len({r[0] for r in rows}) != len(rows):
        raise ValueError("a question id is given twice")
    return spark.createDataFrame(rows, "id string, question string, evidence string, answer string")


def run(questions: DataFrame, examples: list[tuple[str, str]], generate: Callable[[DataFrame], DataFrame] = prompting.mock_generate, instruction: str = "") -> tuple[DataFrame, DataFrame]:
    """(answers, macro scores) of questions (id, question, evidence, answer).

    Evidence stands before the question where there is any; questions without a reference
    are answered and not scored.
    """
    shown = F.when(F.col("evidence").rlike(r"(?U)[^\s]"), F.concat(F.col("evidence"), F.lit("\n\n"), F.col("question"))).otherwise(F.col("question"))
    prompts = questions.where("question is not null").select("id", prompting.few_shot(examples, shown, instruction).alias("prompt"))
    answers = stored(generate(prompts)).select("id", prompting.clean_answer(F.coalesce("raw_answer", F.lit(""))).alias("answer"), "status", "error_code")
    known = questions.where("answer is not null").select("id", F.col("answer").alias("reference"))
    scored = evaluation.score_cases(known.join(answers.select("id", F.col("answer").alias("prediction")), "id"))
    return answers, evaluation.macro(scored)
