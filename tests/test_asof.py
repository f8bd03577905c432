import random

import pytest

from labarr.operators import asof


def brute(left, right, method, tolerance):
    out = []
    best = {}
    for k, v in right:
        if k is not None:
            best[k] = min(best.get(k, v), v)
    for i, k in left:
        hit = None
        if k is not None:
            before = max((x for x in best if x <= k), default=None)
            after = min((x for x in best if x >= k), default=None)
            if method == "ffill":
                hit = before
            elif method == "bfill":
                hit = after
            else:
                hit = after if before is None or (after is not None and after - k < k - before) else before
            if hit is not None and tolerance is not None and abs(hit - k) > tolerance:
                hit = None
        out.append((i, k, hit, None if hit is None else best[hit]))
    return sorted(out, key=str)


@pytest.mark.parametrize("method", ["ffill", "bfill", "nearest"])
@pytest.mark.parametrize("tolerance", [None, 2.0])
@pytest.mark.parametrize("cuts", [False, True])
def test_equals_brute_force(spark, monkeypatch, method, tolerance, cuts):
    rng = random.Random(7)
    left = [(i, rng.choice([None, *range(-5, 60)])) for i in range(80)]
    right = [(rng.choice([None, *range(0, 50, 3)]), float(rng.randrange(9))) for _ in range(40)]
    if cuts:
        from pyspark.sql import functions as F

        monkeypatch.setattr(asof, "_cuts", lambda df, on: [F.lit(c).cast("long") for c in (10, 11, 30, 45)])
    a = spark.createDataFrame([(i, k) for i, k in left], "i int, k long")
    b = spark.createDataFrame(right, "k long, v double")
    got = asof.asof_join(a, b, "k", ["v"], None, method, tolerance)
    assert got.columns == ["i", "k", "k_right", "v"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(left, right, method, tolerance)


def test_groups_empty_sides_and_methods(spark):
    a = spark.createDataFrame([("x", 5), ("y", 5), ("z", 5)], "g string, k long")
    b = spark.createDataFrame([("x", 3, 1.0), ("y", 6, 2.0)], "g string, k long, v double")
    got = {r["g"]: r["v"] for r in asof.asof_join(a, b, "k", ["v"], ["g"]).collect()}
    assert got == {"x": 1.0, "y": None, "z": None}
    assert [r["v"] for r in asof.asof_join(a, b.limit(0), "k", ["v"]).collect()] == [None] * 3
    assert asof.asof_join(a.limit(0), b, "k", ["v"]).collect() == []
    with pytest.raises(ValueError):
        asof.asof_join(a, b, "k", ["v"], None, "sideways")
