import numpy as np
import pytest
from pyspark.sql import functions as F

from labarr.llm import ann

SCHEMA = "vec_id long, embedding array<float>, rank string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "c", "c") for i, v in rows], SCHEMA)


def brute(rows, modulus, k=10):
    ok = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        v = tuple(np.float32(x) for x in v)
        ok[i] = min(ok.get(i, v), v)
    out = {}
    for q, v in ok.items():
        if q % modulus == 0:
            d = sorted((float(np.sqrt(((np.array(v, float) - np.array(w, float)) ** 2).sum())), i) for i, w in ok.items() if i != q)
            out[q] = d[:k]
    return out


def search(spark, rows, **kw):
    out = {}
    for r in sorted(ann.search(frame(spark, rows), **kw).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_exact_where_every_leaf_is_searched(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6)) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(30)] + [(300 + i, [0, 0, 0, 0, 0, 1]) for i in range(5)]
    rows += [(500, None), (600, [0] * 6), (700, [1, None, 0, 0, 0, 0]), (800, [1, np.nan, 0, 0, 0, 0]), (900, [np.inf] * 6), (None, [1] * 6), (40, rows[40][1]), (50, [9] * 6)]
    got, want = search(spark, rows, modulus=10, share=1e9), brute(rows, 10)
    assert set(got) == set(want)
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]], q
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in want[q]], abs=1e-12)


def test_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4)) for i in range(150)]
    whole = search(spark, rows, modulus=5, share=0.6)
    monkeypatch.setattr(ann, "ROWS", 7)
    monkeypatch.setattr(ann, "QUERIES", 3)
    assert search(spark, rows, modulus=5, share=0.6) == whole


def test_recall_on_structureless_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64))
    rows = [(i, v / np.linalg.norm(v)) for i, v in enumerate(x)]
    got, want = search(spark, rows, modulus=100), brute(rows, 100)
    recall = np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want])
    assert recall >= 0.9


def test_small_and_empty_tables(spark):
    assert search(spark, []) == {} and search(spark, [(0, None)]) == {}
    assert search(spark, [(0, [1, 2])]) == {}
    assert search(spark, [(0, [1, 2]), (3, [1, 3])], modulus=100) == {0: [(1.0, 3)]}
    assert search(spark, [(0, [1, 2]), (3, [1, 3]), (4, [1, 2, 3])], modulus=100) == {0: [(1.0, 3)]}


def test_doubles_stay_doubles(spark):
    df = spark.createDataFrame([(0, [1.0, 1e-12]), (1, [1.0, 2e-12])], "vec_id long, embedding array<double>")
    assert ann.search(df, modulus=100).first()["score"] == pytest.approx(1e-12)
    assert df.select(F.max("vec_id")).first()[0] == 1
