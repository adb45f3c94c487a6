import re
from pathlib import Path

import __spark_entry__ as entry
from lexforge.llm import queries

ROOT = Path(__file__).resolve().parents[2]


def test_nothing_else_imports_the_package():
    for path in (ROOT / "lexforge").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(?:from|import)\s.*\bllm\b", path.read_text(), re.M), path


def test_every_problem_has_its_queries():
    names = queries.queries()
    assert {n.split("_")[0] for n in names} == {f"p{i}" for i in range(1, 11)}
    assert set(names) <= set(entry.queries()) and set(queries.oracle_sql()) <= set(names)


def test_queries_equal_their_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    for f in Path(small).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    for name, sql in queries.oracle_sql().items():
        relation = con.sql(sql)
        columns = sorted(relation.columns)
        got = sorted(tuple(r[c] for c in columns) for r in queries.queries()[name](spark, small).collect())
        at = [relation.columns.index(c) for c in columns]
        assert got == sorted(tuple(r[i] for i in at) for r in relation.fetchall())
