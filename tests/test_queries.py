"""Every query against its SQL on the smallest tables, and the driver's contract."""

import math
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
entry = __import__("__spark_entry__")
CORE = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    want = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).columns == ["day", "value"]


def test_text_operators_are_optional():
    import ast
    import pathlib

    root = pathlib.Path(entry.__file__).parent
    for p in (root / "labarr").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n for n in names), p
