"""Writers: small artefacts are atomic and never overwritten silently; tables are Spark's."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..governance import redacted


class Conflict(FileExistsError):
    """Another content is there already."""


def write_once(root: str, name: str, data: bytes) -> Path:
    """Writes a file below ``root`` by rename; the same content again is fine, another is refused."""
    base = Path(root).resolve()
    path = (base / name).resolve()
    if base not in path.parents:
        raise PermissionError(f"{name} is outside {root}")
    if path.exists():
        if path.read_bytes() == data:
            return path
        raise Conflict(str(path))
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, scratch = tempfile.mkstemp(dir=path.parent)
    try:
        with os.fdopen(handle, "wb") as file:
            file.write(data)
            file.flush()
            os.fsync(file.fileno())
        os.link(scratch, path)
    except FileExistsError:
        if path.read_bytes() != data:
            raise Conflict(str(path)) from None
    finally:
        os.unlink(scratch)
    return path


def write_json(root: str, name: str, value: object) -> Path:
    """Redacted JSON with sorted keys."""
    return write_once(root, name, (json.dumps(redacted(value), ensure_ascii=False, sort_keys=True, indent=2) + "\n").encode())


def write_report(path: str, value: object, overwrite: bool = False) -> Path:
    """A report as sorted JSON; an existing file is only replaced when told."""
    target = Path(path)
    if target.exists() and not overwrite:
        raise Conflict(f"{path} exists; overwriting must be asked for")
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(redacted(value), ensure_ascii=False, sort_keys=True, indent=2) + "\n", encoding="utf-8", newline="\n")
    return target


def write_json_lines(df: DataFrame, path: str, *order: str) -> None:
    """JSON lines sorted by the given columns, a file per range of the order; existing output is refused."""
    df.orderBy(*order).write.mode("errorifexists").json(path, ignoreNullFields=False)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def append_runs(spark: SparkSession, runs: DataFrame, path: str) -> None:
    """Appends registry rows; a run id that is there already refuses all of them."""
    repeated = runs.groupBy("run_id").count().where("count > 1")
    if repeated.limit(1).count():
        raise Conflict("run_id given twice")
    try:
        known = spark.read.schema(runs.schema).json(path)
        if runs.join(known, "run_id", "left_semi").limit(1).count():
            raise Conflict("run_id registered already")
    except Exception as error:  # noqa: BLE001 - only a missing registry is fine
        if "PATH_NOT_FOUND" not in str(error):
            raise
    runs.write.mode("append").json(path, ignoreNullFields=False)


def folder_hash(files: DataFrame) -> str:
    """SHA-256 over sorted (path, sha256) of a manifest: digests are combined, contents stay on the executors."""
    rows = files.select("path", "sha256").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\t", "path", "sha256"))), "\n"), 256).alias("h"))
    return rows.first()["h"] or hashlib.sha256(b"").hexdigest()
