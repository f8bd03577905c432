import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from labarr.operators import DataArray
from labarr.operators.combine import where
from labarr.plans.index import Index, LabelError

NAN = float("nan")


@pytest.fixture
def make(spark):
    return lambda data, dims=None, coords=None, **kw: DataArray.from_nested(spark, data, dims, coords, **kw)


def same(a, b):
    if isinstance(a, list):
        return len(a) == len(b) and all(same(x, y) for x, y in zip(a, b, strict=True))
    return (a is None and b is None) or (a is not None and b is not None and (a == b or (a != a and b != b)))


def test_construction_checks(spark, make):
    a = make([[1, 2], [3, 4]])
    assert (a.dims, a.shape, a.coords) == (("dim_0", "dim_1"), (2, 2), {"dim_0": [0, 1], "dim_1": [0, 1]})
    with pytest.raises(ValueError, match="Number of dimensions"):
        make([1, 2], ["x", "y"])
    with pytest.raises(ValueError, match="not found in dimensions"):
        make([1], ["x"], {"y": [1]})
    with pytest.raises(ValueError, match="length mismatch"):
        make([1, 2], ["x"], {"x": [1]})
    with pytest.raises(ValueError, match="does not match shape"):
        DataArray.from_flat(spark, [1, 2, 3], (2, 2))
    with pytest.raises(ValueError, match="non-negative"):
        DataArray.from_flat(spark, [], (-1,))
    with pytest.raises(ValueError, match="ragged"):
        make([[1], [2, 3]])
    assert make(5).item() == 5


def test_typed_buffers_keep_their_type(spark):
    a = DataArray.from_flat(spark, np.array([1, 2], np.int16), (2,))
    assert a.dtype.simpleString() == "smallint" and a.data() == [1, 2]
    assert DataArray.from_nested(spark, np.array([[0.5]], np.float32)).dtype.simpleString() == "float"


WEEK = (["Mon", "Tue", "Wed", "Thu", "Fri"], [20, 22, 25, 23, 21])


def test_selection_by_label(make):
    a = make(WEEK[1], ["time"], {"time": WEEK[0]})
    assert a.sel({"time": "Wed"}).item() == 25
    assert a.sel({"time": ["Mon", "Wed", "Fri"]}).data() == [20, 25, 21]
    got = a.sel({"time": {"start": "Tue", "stop": "Thu"}})
    assert got.data() == [22, 25, 23] and got.coords["time"] == ["Tue", "Wed", "Thu"]
    assert a.sel({"time": slice("Wed", None)}).data() == [25, 23, 21]
    assert a.sel({"time": ["Fri", "Mon", "Fri"]}).data() == [21, 20, 21]
    assert a.sel({"other": 3}).data() == WEEK[1]
    assert a.sum().item() == 111 and a.mean().item() == pytest.approx(22.2)
    with pytest.raises(LabelError):
        a.sel({"time": {"start": "Tue", "stop": "Sun"}})
    assert a.sel({"time": {"start": "Thu", "stop": "Tue"}}).data() == []


def test_selection_in_more_dimensions(make):
    a = make([[0, 1, 2, 3], [4, 5, 6, 7]], ["y", "x"], {"y": ["top", "bottom"], "x": list("abcd")})
    assert a.sel({"x": {"stop": "b"}}).data() == [[0, 1], [4, 5]]
    assert a.sel({"x": {"start": "c"}}).data() == [[2, 3], [6, 7]]
    assert a.sel({"y": "top", "x": "d"}).item() == 3
    grid = make([[1, 2, 3], [4, 5, 6], [7, 8, 9]], ["y", "x"], {"y": [0, 10, 20], "x": [0, 5, 10]})
    assert grid.sel({"y": 8, "x": 6}, method="nearest").item() == 5
    near = make([10, 20, 30], ["x"], {"x": [1, 2, 3]}).sel({"x": [1.1, 2.2]}, method="nearest")
    assert near.data() == [10, 20] and near.coords["x"] == [1, 2]
    between = make([10, 20, 30, 40], ["x"], {"x": [0, 10, 20, 30]}).sel({"x": {"start": 9, "stop": 21}}, method="nearest")
    assert between.data() == [20, 30] and between.coords["x"] == [10, 20]


def test_selection_by_position(make):
    a = make([[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]], ["row", "col"])
    assert a.isel({"row": [2, 0], "col": [3, 1]}).data() == [[11, 9], [3, 1]]
    assert a.isel({"row": -1, "col": -2}).item() == 10
    assert a.isel({"row": []}).shape == (0, 4)
    assert make([10, 11, 12], ["x"], {"x": [5, 5, 7]}).isel({"x": 1}).item() == 11
    for bad in (3, -4, 1.5, [0, 9]):
        with pytest.raises(IndexError):
            a.isel({"row": bad})
    assert a.isel({"none": 99}).shape == (3, 4)
    assert a.isel({"row": slice(None, None, -2)}).data() == [[8, 9, 10, 11], [0, 1, 2, 3]]


def test_chained_selections_equal_one(make):
    a = make([100 + i for i in range(6)], ["x"], {"x": [0, 10, 20, 30, 40, 50]})
    assert a.sel({"x": {"start": 20, "stop": 50}}).sel({"x": 30}).item() == 103
    points = a.sel({"x": [0, 20, 50]})
    assert points.sel({"x": 20}).item() == 102
    assert points.sel({"x": {"start": 20, "stop": 50}}).data() == [102, 105]
    assert points.original_index("x", 2) == 5
    cube = make([[[p * 10000 + r * 100 + c for c in range(3)] for r in range(40)] for p in range(2)], ["p", "r", "c"])
    assert cube.isel({"p": 1, "r": [39, 0, 20], "c": [2, 0]}).data() == [[13902, 13900], [10002, 10000], [12002, 12000]]


def test_filters_reach_the_scan(spark, tmp_path):
    cells = spark.range(1000).select(F.col("id").alias("__i_x"), (F.col("id") * 2).cast("double").alias("value"), F.lit(1).alias("unused"))
    cells.write.parquet(str(tmp_path / "c"))
    a = DataArray.from_cells(spark.read.parquet(str(tmp_path / "c")), ["x"], [1000])
    got = a.isel({"x": slice(10, 500)}).isel({"x": slice(5, 9)})
    plan = got.cells._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(__i_x,15)" in plan and "LessThanOrEqual(__i_x,18)" in plan and "unused" not in plan
    assert got.data() == [30, 32, 34, 36]


def test_reductions(make):
    a = make([[1, 2, 3], [4, 5, 6]], ["y", "x"])
    assert a.sum("x").data() == [6, 15] and a.mean("x").data() == [2, 5]
    cube = make(np.arange(1, 25, dtype=float).reshape(2, 3, 4), ["plane", "row", "col"])
    assert (cube.sum().item(), cube.mean().item()) == (300, 12.5)
    assert cube.sum("col").data() == [[10, 26, 42], [58, 74, 90]]
    assert cube.mean("row").data() == [[5, 6, 7, 8], [17, 18, 19, 20]]
    empty = a.isel({"y": []})
    assert empty.sum("y").data() == [0, 0, 0] and all(math.isnan(v) for v in empty.mean("y").data())
    assert a.isel({"x": []}).sum("x").data() == [0, 0]
    assert empty.sum().item() == 0 and math.isnan(empty.mean().item())
    with pytest.raises(ValueError, match="not found"):
        a.sum("z")


def test_missing_cells_in_reductions(make):
    a = make([[1, None, NAN], [3, None, 5]], ["y", "x"])
    assert same(a.mean("y").data(), [2, NAN, 5])
    assert same(a.sum("y").data(), [4, 0, NAN])
    assert (a.sum().item(), a.count().item(), a.mean().item()) == (9, 3, 3)
    flags = make([True, False, True])
    assert flags.sum().item() == 2 and flags.mean().item() == pytest.approx(2 / 3) and flags.sum("dim_0").item() == 2
    words = make(["a", "b"])
    assert words.sum().item() == 0 and math.isnan(words.mean().item())
    with pytest.raises(TypeError):
        words.sum("dim_0")


def test_other_reducers(make):
    a = make([[1, 2, 3], [4, 5, 6]], ["y", "x"])
    assert a.reduce("x", "product").data() == [6, 120] and a.reduce("y", "max").data() == [4, 5, 6] and a.reduce(None, "min").item() == 1
    assert a.fold("x", lambda acc, v: acc * 10 + v).data() == [123, 456]


def test_where(make):
    a = make([0.1, 0.6, 0.4, 0.8], ["x"], attrs={"u": 1}, name="p")
    got = a.where(make([True, False, True, False], ["x"]), -1, keep_attrs=True)
    assert got.data() == [0.1, -1, 0.4, -1] and got.attrs == {"u": 1} and got.name == "p"
    cond = make([True, False], ["x"])
    got = DataArray.choose(cond, make([1, 2], ["y"], {"y": ["a", "b"]}), 0)
    assert got.dims == ("x", "y") and got.data() == [[1, 2], [0, 0]]
    v = make([i / 10 for i in range(10)], ["x"])
    assert DataArray.choose(v.lt(0.5), v, v.multiply(100)).data() == pytest.approx([0, 0.1, 0.2, 0.3, 0.4, 50, 60, 70, 80, 90])
    truth = make([NAN, 0, 1, -2, float("inf"), None], ["x"])
    assert make([10, 20, 30, 40, 50, 60], ["x"]).where(truth, -1).data() == [10, -1, 30, 40, 50, -1]
    assert make([10, 20], ["x"]).where(make(["", "0"], ["x"]), -1).data() == [-1, 20]
    masked = make([1, 2, 3, 4], ["x"]).where(make([True, True, False, False], ["x"]))
    assert masked.data() == [1, 2, None, None] and masked.mean().item() == 1.5 and masked.mean("x").item() == 1.5
    with pytest.raises(TypeError):
        v.where([True] * 10)
    assert where(cond, 1, 0, keep_attrs=lambda ops: {"n": len(ops)}).attrs == {"n": 3}


def test_comparisons(make):
    a = make([1, 2, 3], ["x"], attrs={"u": 1})
    assert a.lt(2).data() == [True, False, False] and a.lt(2).attrs == {}
    assert a.lt(2, keep_attrs=True).attrs == {"u": 1} and a.add(1, keep_attrs=False).attrs == {}
    assert a.add(1, keep_attrs=lambda ops: {"n": sorted(ops)}).attrs == {"n": ["left", "right"]}
    odd = make([1, NAN, None, 0.0], ["x"])
    assert odd.gt(0).data() == [True, False, None, False]
    assert odd.le(NAN).data() == [False, False, None, False]
    assert odd.eq(odd).data() == [True, False, True, True] and odd.ne(odd).data() == [False, True, False, False]
    assert odd.eq("1").data() == [False, False, False, False]
    with pytest.raises(Exception, match="numeric operands"):
        odd.gt(0, strict=True).data()
    with pytest.raises(TypeError, match="numeric operands"):
        make(["a"]).lt(1)


def test_arithmetic(make):
    a = make([1, -1, 0, NAN, None], ["x"], attrs={"u": 1}, name="n")
    assert same(a.divide(0).data(), [math.inf, -math.inf, NAN, NAN, None])
    assert same(a.divide(make([-0.0] * 5, ["x"])).data(), [-math.inf, math.inf, NAN, NAN, None])
    assert same((a + 1).data(), [2, 0, 1, NAN, None]) and (a + 1).attrs == {"u": 1} and (a + 1).name == "n"
    assert same(make([-8, 0, NAN]).power(make([1 / 3, -1, 0])).data(), [NAN, math.inf, 1])
    b = make([[1, 2], [3, 4]], ["y", "x"], {"x": ["a", "b"]})
    assert b.subtract(b.mean("y")).data() == [[-1, -1], [1, 1]]
    assert make([1, 2], ["p"]).multiply(make([10, 20, 30], ["q"])).data() == [[10, 20, 30], [20, 40, 60]]
    with pytest.raises(ValueError, match="Coordinate mismatch for dimension 'x'"):
        b.add(make([1, 2], ["x"], {"x": ["a", "c"]}))
    with pytest.raises(Exception, match="numeric operands"):
        a.add(1, strict=True).data()


def test_operands_over_one_frame_need_no_join(spark):
    frame = spark.range(10).select(F.col("id").alias("__i_x"), F.col("id").cast("double").alias("a"), (F.col("id") * 2).cast("double").alias("b"))
    a = DataArray.from_cells(frame, ["x"], [10], None, "a")
    from labarr.plans.source import FrameSource

    b = DataArray(FrameSource(frame, ("x",), (10,), "b"), a.indexes)
    got = a.isel({"x": slice(2, 5)}).add(b.isel({"x": slice(2, 5)}))
    assert "Join" not in got.cells._jdf.queryExecution().executedPlan().toString()
    assert got.data() == [6, 9, 12]


@pytest.mark.parametrize("window", [1, 2, 3, 4, 7, 11, 200])
@pytest.mark.parametrize("center", [False, True])
def test_rolling_equals_clipped_windows(make, window, center):
    rng = np.random.default_rng(3)
    values = rng.normal(size=200).tolist()
    values[19] = values[151] = NAN
    values[73] = None
    for least in (None, 1, 5):
        r = make(values, ["t"]).rolling("t", window, center=center, min_periods=least)
        after = window - 1 - (window - 1) // 2 if center else 0
        want_sum, want_mean = [], []
        for i in range(200):
            held = [v for v in values[max(0, i - (window - 1 - after)) : i + after + 1] if v is not None and v == v]
            ok = len(held) >= max(1, window if least is None else least)
            want_sum.append(sum(held) if ok else None)
            want_mean.append(sum(held) / len(held) if ok else None)
        for got, want in ((r.sum().data(), want_sum), (r.mean().data(), want_mean)):
            assert [g is None for g in got] == [w is None for w in want]
            assert [g for g in got if g is not None] == pytest.approx([w for w in want if w is not None], abs=1e-11)


def test_rolling_literals(make):
    assert make([1, 2, 3, 4], ["t"]).rolling("t", 2).mean().data() == [None, 1.5, 2.5, 3.5]
    assert make([1, 2, 3, 4, 5], ["t"]).rolling("t", 3, center=True, min_periods=2).sum().data() == [3, 6, 9, 12, 9]
    assert make([[1, 2], [3, 4], [5, 6]], ["time", "x"]).rolling("time", 2).mean().data() == [[None, None], [2, 3], [4, 5]]
    assert make([True, False], ["t"]).rolling("t", 1).sum().data() == [None, None]
    for bad in (0, -1, NAN, 0.5):
        with pytest.raises(ValueError):
            make([1], ["t"]).rolling("t", bad)
    with pytest.raises(ValueError):
        make([1], ["t"]).rolling("z", 2)


def test_rolling_over_blocks(spark, monkeypatch):
    from labarr.operators import rolling

    monkeypatch.setattr(rolling, "BLOCK", 50)
    a = DataArray.from_cells(spark.range(500).select(F.col("id").alias("__i_x"), F.col("id").cast("double").alias("value")), ["x"], [500])
    for window, center in ((7, False), (8, True), (50, True)):
        got = a.rolling("x", window, center=center, min_periods=1).sum().data()
        after = window - 1 - (window - 1) // 2 if center else 0
        assert got == [float(sum(range(max(0, i - (window - 1 - after)), min(500, i + after + 1)))) for i in range(500)]
    wild = a.where(a.ne(100), math.inf).rolling("x", 10).sum().data()
    assert wild[99] == sum(range(90, 100)) and all(math.isinf(v) for v in wild[100:110]) and wild[110] == sum(range(101, 111))


def test_long_windows_know_only_their_own_cells(make):
    a = make([1e16] + [1.0] * 399, ["x"])
    for window in (127, 128, 200):
        assert a.rolling("x", window).sum().data()[300] == window


def test_rolling_where_cells_have_no_row(spark):
    cells = spark.createDataFrame([(0, 1.0), (1, 2.0), (5, 3.0), (6, 4.0)], "__i_x long, value double")
    got = DataArray.from_cells(cells, ["x"], [8]).rolling("x", 3, min_periods=1).sum().cells.collect()
    assert sorted(map(tuple, got)) == [(0, 1.0), (1, 3.0), (5, 3.0), (6, 7.0)]


def test_sinks(make):
    a = make([[1.23456789, None], [NAN, -9.87654321]], ["lat", "lon"], {"lat": [10.123456789, 20.987654321], "lon": [-70.123456789, -60.987654321]})
    for p, lats in ((6, [10.123457, 20.987654]), (2, [10.12, 20.99]), (0, [10, 21])):
        rows = a.collect_records(p)
        assert [r["lat"] for r in rows] == [lats[0]] * 2 + [lats[1]] * 2
        assert same([r["value"] for r in rows], [1.23456789, None, NAN, -9.87654321])
    half = make([1], ["x"], {"x": [-2.5]}).collect_records(0)
    assert half[0]["x"] == -2
    times = make([1, 2], ["time"], {"time": [59, 60]}, attrs={"_coordAttrs": {"time": {"units": "days since 2000-01-01", "calendar": "360_day"}}})
    assert [r["time"] for r in times.collect_records()] == ["2000-02-30T00:00:00", "2000-03-01T00:00:00.000Z"]
    assert a.to_object()["shape"] == [2, 2] and '"data": [[1.23456789, null], [null, -9.87654321]]' in a.to_json()
    assert a.flat_data()["shape"] == [2, 2] and a.get_value((1, 1)) == -9.87654321
    with pytest.raises(IndexError):
        a.get_value((2, 0))
    assert make([1, 2, 3]).to_numpy().tolist() == [1, 2, 3]
    assert "dim_0: 3" in repr(make([1, 2, 3]))


def test_coords_and_squeeze(make):
    a = make([[1], [2]], ["x", "one"])
    assert a.squeeze().dims == ("x",) and a.squeeze().data() == [1, 2]
    b = a.assign_coords({"x": [5, 7]})
    assert b.sel({"x": 7, "one": 0}).item() == 2 and a.coords["x"] == [0, 1]
    assert a.assign_coords({"x": make([8, 9], ["x"])}).coords["x"] == [8, 9]
    for bad in ({"z": [1]}, {"x": [1]}, {"x": make([1, 2], ["y"])}):
        with pytest.raises(ValueError):
            a.assign_coords(bad)
    assert a.clone_with(name="q").name == "q"
    done = a.compute()
    assert done.compute() is done and not done.is_lazy and done.data() == [[1], [2]]


def test_what_labels_say(make):
    a = make([[1, 2], [3, 4]], ["lat", "lon"], {"lat": [1.23456789, 2], "lon": [-3, 4]})
    assert a.get_bounds() == {"latMin": 1.234568, "latMax": 2, "lonMin": -3, "lonMax": 4}
    assert a.get_bounds(precision=None)["latMin"] == 1.23456789 and make([1], ["q"]).get_bounds() is None
    hours = make([1, 2], ["time"], {"time": [0, 6]}, attrs={"_coordAttrs": {"time": {"units": "hours since 2000-01-01"}}})
    assert hours.calculate_time_resolution() == {"value": 6, "type": "6-hourly", "unit": "hours"} and hours.attrs["time_resolution"] == 6
    days = lambda step: make([1, 2], ["time"], {"time": [0, step]}, attrs={"units": "days since 2000-01-01"}).calculate_time_resolution()
    assert [days(s)["type"] for s in (1, 7, 30, 31, 365, 100)] == ["daily", "weekly", "monthly", "monthly", "yearly", "custom"]
    assert make([1, 2], ["time"], {"time": ["a", "b"]}).calculate_time_resolution() is None
    assert Index([1]).kind == "number"
