import math

import duckdb
import pytest

import __spark_entry__ as entry
from lexforge.governance import Profile
from lexforge.plans import catalogue, pipeline


def normal(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "~"
    if isinstance(value, (list, tuple)):
        return str([normal(v) for v in value])
    if isinstance(value, float):
        return repr(round(value, 5) + 0.0)
    return str(value)


@pytest.fixture(scope="module")
def duck(small):
    from pathlib import Path

    con = duckdb.connect()
    for f in Path(small).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, small, duck, name):
    df = catalogue.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = sorted("|".join(normal(r[c]) for c in columns) for r in df.collect())
    relation = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    assert got == sorted("|".join(normal(r[i]) for i in at) for r in relation.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, small, name):
    assert catalogue.queries()[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_pipeline_direct_and_rag(spark, small):
    q = spark.createDataFrame([("1", "Mức thu đối với giấy phép khai thác bến nổi là bao nhiêu?"), ("2", "zzzz")], "id string, question string")
    direct = pipeline.run(q, None, Profile(method="direct"), catalogue.DIRECT)
    assert {r["status"] for r in direct.predictions.collect()} == {"success"}
    docs = spark.read.parquet(f"{small}/legal_documents.parquet").dropDuplicates(["id"])
    rag = pipeline.run(q, docs, Profile(), catalogue.RAG)
    assert {r["id"]: r["error_code"] for r in rag.predictions.collect()} == {"1": None, "2": "RETRIEVAL_ERROR"}
    assert pipeline.counts(rag.predictions).first()["n_success"] == 1
