"""Readers of source files as DataFrames: one task per file or per range of archive members."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import parse

PROBLEMS = "source string, code string, detail string"
_CONTEXT = re.compile(r"context_[^/]*\.json\Z", re.I)


def binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def _parsed(files: DataFrame, schema: str, names: list[str], parser: Callable[[bytes, str], tuple[list[tuple], list[tuple[str, str]]]]) -> DataFrame:
    """(source, *schema, code, detail): a row per parsed record, and one per problem with null fields."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"]):
                rows, problems = parser(bytes(content), path)
                out += [(path, *row, None, None) for row in rows]
                out += [(path, *[None] * len(names), code, detail) for code, detail in problems]
            yield pd.DataFrame(out, columns=["source", *names, "code", "detail"], dtype=object)

    return files.select("path", "content").mapInPandas(run, f"source string, {schema}, code string, detail string")


def good(parsed: DataFrame) -> DataFrame:
    return parsed.where("code is null").drop("code", "detail")


def problems(parsed: DataFrame) -> DataFrame:
    return parsed.where("code is not null").select("source", "code", "detail")


def fail_on(parsed: DataFrame, *tolerated: str) -> DataFrame:
    """The records; the query fails at the first problem whose code is not tolerated."""
    bad = F.col("code").isNotNull() & ~F.col("code").isin(*tolerated) if tolerated else F.col("code").isNotNull()
    checked = parsed.where(F.assert_true(~bad, F.concat_ws(" ", "code", "source", "detail")).isNull())
    return good(checked)


# ---- contexts ------------------------------------------------------------------------------

_DOCUMENT = "id string, name string, passage string, link string, source_member string, content_hash string"
_DOCUMENT_NAMES = ["id", "name", "passage", "link", "source_member", "content_hash"]


def _document(data: bytes, member: str | None) -> tuple[list[tuple], list[tuple[str, str]]]:
    import hashlib

    value, problem = parse.document(data)
    if problem:
        return [], [(problem, member or "")]
    return [(value["id"], value["name"], value["passage"], value["link"], member, hashlib.sha256(data).hexdigest())], []


def read_context_folder(spark: SparkSession, path: str) -> DataFrame:
    """Parsed context files of a folder, recursively; other files are the problem UNRELATED_FILE."""
    files = binary(spark, path)
    related = F.element_at(F.split("path", "/"), -1).rlike(r"(?i)^context_.*\.json$")
    parsed = _parsed(files.where(related), _DOCUMENT, _DOCUMENT_NAMES, lambda data, _: _document(data, None))
    other = files.where(~related).select(F.col("path").alias("source"), *[F.lit(None).cast("string").alias(n) for n in _DOCUMENT_NAMES], F.lit("UNRELATED_FILE").alias("code"), F.lit("").alias("detail"))
    return parsed.unionByName(other)


class _Members(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class ZipSource(DataSource):
    """``spark.read.format("zip_members").load(archive)``: (path, member, content), read-only, never extracted."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "path string, member string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _ZipReader(self.options["path"], int(self.options.get("members_per_task", 500)))


class _ZipReader(DataSourceReader):
    def __init__(self, path: str, step: int):
        self.path, self.step = path.removeprefix("file:"), step

    def partitions(self):
        with zipfile.ZipFile(self.path) as archive:
            names = sorted(i.filename for i in archive.infolist() if not i.is_dir())
        return [_Members(names[i : i + self.step]) for i in range(0, len(names), self.step)] or [_Members([])]

    def read(self, partition):
        with zipfile.ZipFile(self.path) as archive:
            for name in partition.names:
                yield self.path, name, archive.read(name)


def read_context_zip(spark: SparkSession, path: str, members_per_task: int = 500) -> DataFrame:
    """Parsed context members of an archive, a task per range of members."""
    spark.dataSource.register(ZipSource)
    members = spark.read.format("zip_members").option("members_per_task", members_per_task).load(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for source, member, content in zip(frame["path"], frame["member"], frame["content"]):
                rows, bad = _document(bytes(content), member) if _CONTEXT.search(member) else ([], [("UNRELATED_FILE", member)])
                out += [(source, *r, None, None) for r in rows] + [(source, *[None] * 6, c, d) for c, d in bad]
            yield pd.DataFrame(out, columns=["source", *_DOCUMENT_NAMES, "code", "detail"], dtype=object)

    return members.mapInPandas(run, f"source string, {_DOCUMENT}, code string, detail string")


def corpus(parsed: DataFrame) -> DataFrame:
    """Documents of a parsed corpus; repeated ids fail the query, warnings (blank, unrelated) are dropped."""
    rows = fail_on(parsed, "BLANK_PASSAGE", "UNRELATED_FILE").withColumnRenamed("source", "source_path")
    once = F.count(F.lit(1)).over(Window.partitionBy("id"))
    return rows.withColumn("_n", once).where(F.assert_true(F.col("_n") == 1, F.concat(F.lit("DUPLICATE_ID "), F.col("id"))).isNull()).drop("_n")


# ---- questions and records -----------------------------------------------------------------

def read_questions(spark: SparkSession, path: str, split: str, answers: bool = False) -> DataFrame:
    """Parsed question maps (source, pos, id, question, answer, split).

    Answers of public and private splits are refused before a file is opened.
    """
    if answers and split in ("public", "private"):
        raise PermissionError(f"answers of the {split} split are withheld")
    parsed = _parsed(binary(spark, path), "pos int, id string, question string, answer string", ["pos", "id", "question", "answer"], lambda data, _: parse.question_map(data, answers))
    return parsed.withColumn("split", F.lit(split))


def read_inference_questions(spark: SparkSession, path: str, split: str) -> DataFrame:
    """(id, question, split), sorted by id; answers are never materialised."""
    return fail_on(read_questions(spark, path, split)).select("id", "question", "split").orderBy("id")


def _is_lines(path: str) -> bool:
    return path.lower().endswith((".jsonl", ".ndjson"))


def read_eval_records(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(binary(spark, path), "id string, answer string", ["id", "answer"], lambda data, p: parse.eval_records(data, _is_lines(p)))


def records(spark: SparkSession, values) -> DataFrame:
    """(id, answer) of a mapping from id to answer, or of (id, answer) pairs or records; the rules of the files hold."""
    pairs = list(values.items()) if hasattr(values, "items") else [(v["id"], v.get("answer", v.get("prediction", v.get("reference")))) if isinstance(v, dict) else tuple(v) for v in values]
    rows = []
    for id_, answer in pairs:
        if id_ is None or isinstance(id_, bool) or not str(id_).strip():
            raise ValueError(f"no id: {id_!r}")
        if answer is not None and not isinstance(answer, str):
            raise ValueError(f"answer of {id_} is no text")
        rows.append((str(id_), answer))
    if len({r[0] for r in rows}) != len(rows):
        raise ValueError("an id is given twice")
    return spark.createDataFrame(rows, "id string, answer string")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(binary(spark, path), ", ".join(f"{n} string" for n in parse.PREDICTION_FIELDS), list(parse.PREDICTION_FIELDS), lambda data, p: parse.predictions(data, _is_lines(p)))


def read_target_ids(spark: SparkSession, path: str) -> DataFrame:
    """(source, pos, id) in the order of the file; values are not read."""
    return _parsed(binary(spark, path), "pos int, id string", ["pos", "id"], lambda data, _: parse.target_ids(data))


def read_reader_csv(spark: SparkSession, path: str) -> DataFrame:
    """(row, id, context, question, answer); a byte order mark is skipped, ids number the rows in file order.

    A quoted field may hold line ends, so a file is parsed in one task; row numbers are the
    parser's own, no shuffle.
    """
    import csv

    def parser(data: bytes, _: str):
        rows = csv.DictReader(io.StringIO(data.decode("utf-8-sig"), newline=""))
        if set(rows.fieldnames or []) < {"context", "question", "answer"}:
            return [], [("MISSING_COLUMN", "")]
        return [(n, f"vilqa-{n}", r["context"], r["question"], r["answer"]) for n, r in enumerate(rows)], []

    return _parsed(binary(spark, path), "row int, id string, context string, question string, answer string", ["row", "id", "context", "question", "answer"], parser)


def split_cases(cases: DataFrame, splits: dict[str, list[str]]) -> DataFrame:
    """Cases with their split; splits must be disjoint, not empty, and cover all ids."""
    rows = [(i, name, n) for name, ids in splits.items() for n, i in enumerate(ids)]
    if len({r[0] for r in rows}) != len(rows) or not all(splits.values()):
        raise ValueError("splits must be disjoint and not empty")
    given = cases.sparkSession.createDataFrame(rows, "id string, split string, pos int")
    joined = cases.join(given, "id", "full")
    whole = F.col("split").isNotNull() & F.col("question").isNotNull()
    return joined.where(F.assert_true(whole, F.concat(F.lit("split does not cover "), F.col("id"))).isNull())


def manifest(spark: SparkSession, path: str, excluded: tuple[str, ...] = ("cache", "output", "outputs")) -> DataFrame:
    """(path, size, sha256) of all files below a folder but for the excluded ones."""
    root = path.removeprefix("file:").rstrip("/") + "/"
    relative = F.regexp_replace(F.col("path"), "^(?:file:)?/*" + re.escape(root.lstrip("/")), "")
    files = binary(spark, path).select(relative.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    return files.where(~F.arrays_overlap(F.split("path", "/"), F.lit(list(excluded)))).orderBy("path")


def read_json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """Strict JSON lines: a row that does not fit the schema fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
