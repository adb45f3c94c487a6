"""Session helpers: table access, shared scratch space, size-checked broadcasts."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_own: dict[str, str] = {}
_written: dict[str, list[str]] = {}

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Largest side, in rows times columns, that may be broadcast by ``small``.
BROADCAST_CELLS = 400_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of the data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local one is set only where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        # one machine: a folder of this session, removed with it
        session = spark.sparkContext.applicationId
        if session not in _own:
            _own[session] = tempfile.mkdtemp(prefix="lexforge-")
            atexit.register(shutil.rmtree, _own[session], ignore_errors=True)
        folder = _own[session]
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder, with their lineage cut; survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, tidy: bool = False) -> DataFrame:
    """Like ``cut`` but as a Parquet table, so that later reads prune columns and push filters.

    ``tidy``: the shuffle files behind it are deleted as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    if tidy:
        before = spark.conf.get(SHUFFLE_CLEANUP)
        spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    else:
        df.write.parquet(path)
    return spark.read.parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes the tables ``stored`` by this session; for the end of a run, when its results are written."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    return len(paths)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Partitioned by the keys into the session's number of shuffle partitions.

    For groups that Python works on: their cost is not their size in bytes, by which
    adaptive execution would put many of them into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def fold(df: DataFrame, key: str, order: list[str], run: Callable[[list], list[tuple]], schema: str) -> DataFrame:
    """Order-dependent work per key: ``run`` gets the rows of one key, sorted, and returns rows of ``schema``.

    Keys are spread over the partitions and sorted there, so a task streams through its keys
    in Arrow batches; only one key's rows are held at a time.
    """
    at, names = df.columns.index(key), [f.name for f in StructType.fromDDL(schema).fields]

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list = []
        for frame in frames:
            out: list[tuple] = []
            for row in frame.itertuples(index=False):
                if rows and row[at] != rows[0][at]:
                    out.extend(run(rows))
                    rows = []
                rows.append(row)
            yield pd.DataFrame(out, columns=names, dtype=object)
        if rows:
            yield pd.DataFrame(run(rows), columns=names, dtype=object)

    return spread(df, key).sortWithinPartitions(key, *order).mapInPandas(apply, schema)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Marks ``df`` for broadcast if its counted size allows it; otherwise it stays a shuffled side."""
    return F.broadcast(df) if rows * max(1, len(df.columns)) <= BROADCAST_CELLS else df


def blocks(total: float, limit: float) -> int:
    """How many blocks of at most ``limit`` hold ``total``."""
    return max(1, math.ceil(total / limit))


def latest(df: DataFrame, keys: list[str], by: str | None = "received_at") -> DataFrame:
    """One row per key: re-deliveries count once.

    The last received wins; ties and tables without that column are settled by a hash of
    the whole row, so the result does not depend on the order of rows.  The choice is a
    partially aggregated ``max_by``, so a hot key never meets in one task.
    """
    kept = [c for c in df.columns if c not in keys]
    if not kept:
        return df.distinct()
    order = F.struct(*([F.col(by)] if by and by in df.columns else []), F.xxhash64(*[F.col(c) for c in kept if not _is_map(df, c)]))
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*kept), order).alias("_row"))
        .select(*keys, *[F.col("_row")[c].alias(c) for c in kept])
        .select(*df.columns)
    )


def _is_map(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() == "map"
