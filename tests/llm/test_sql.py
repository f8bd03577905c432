"""Text queries against their SQL, and what can't be said in SQL against the test tables' facts."""

import math
import os

import duckdb
import pytest

from labarr.llm import queries

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    want = db.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    assert got == sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in want.fetchall())


def test_license_and_secret_sql_on_planted_rows(spark, tmp_path):
    """The test tables hold few of either, so rows are planted."""
    from labarr.llm import licenses, secrets

    key = "ghp_" + "aB3" * 12
    texts = [t for _, _, t in licenses.TEMPLATES] + ["under the MIT license", "cc by nc, apache license version 2", f"é {key} x", f"token={key}", "AKIA" + "Z9" * 8, "password: 'hunter22' " + "ab12" * 9, "Mixed9" * 5, "x" * 500 + " secret = 12345678\n" + "f" * 32, "", "-----BEGIN RSA PRIVATE KEY-----"]
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name, got in (("op3_licenses", licenses.scan(df)), ("op6_secrets", secrets.scan(df).drop("found"))):
        want = db.execute(queries.ORACLES[name])
        columns = sorted(c[0] for c in want.description)
        at = {c[0]: i for i, c in enumerate(want.description)}
        found = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
        assert found == sorted(tuple(plain(r[at[c]]) for c in columns) for r in want.fetchall()), name
        assert any(r[columns.index("labels" if name == "op3_licenses" else "spans")] for r in found)
