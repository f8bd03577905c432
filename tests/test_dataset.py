import pytest

from labarr.operators import DataArray, Dataset


@pytest.fixture
def make(spark):
    return lambda data, dims=None, coords=None, **kw: DataArray.from_nested(spark, data, dims, coords, **kw)


@pytest.fixture
def weather(make):
    t = make([[1, 2], [3, 4], [5, 6]], ["time", "x"], {"time": [2020, 2021, 2022], "x": [10, 20]})
    return Dataset({"t": t, "p": t.multiply(100)}, attrs={"a": 1})


def test_invariants(make, weather):
    assert weather.data_vars == ["t", "p"] and weather.dims == ["time", "x"] and weather.sizes == {"time": 3, "x": 2}
    with pytest.raises(ValueError, match="Dimension 'x'"):
        weather.add_variable("q", make([1, 2, 3], ["x"]))
    assert Dataset({"v": make([1], ["x"], {"x": [0.123456789]})}).coords == {"x": [0.123457]}
    with pytest.raises(KeyError, match="not found"):
        weather.get_variable("nope")
    assert weather.has_variable("t") and weather.remove_variable("p") and not weather.remove_variable("p")


def test_selection(weather):
    got = weather.sel({"time": 2021, "x": [20, 10]})
    assert got["t"].data() == [4, 3] and got.coords == {"x": [20, 10]}
    assert weather.isel({"time": -1})["p"].data() == [500, 600]
    assert weather.get(["p"]).data_vars == ["p"]


def test_projection(make, weather):
    assert weather.drop_vars("none") is weather and weather.drop_vars(["t"]).data_vars == ["p"]
    assert weather.rename({"t": "temp"}).data_vars == ["temp", "p"]
    with pytest.raises(KeyError):
        weather.rename({"zz": "a"})
    with pytest.raises(ValueError):
        weather.rename({"t": "p"})
    assert weather.assign_coords({"x": [7, 8]}).sel({"x": 8})["t"].data() == [2, 4, 6]
    with pytest.raises(ValueError):
        weather.assign_coords({"zz": [1]})
    one = Dataset({"a": make([[1], [2]], ["station", "extra"]), "b": make([[50], [60]], ["station", "extra"])}).squeeze()
    assert one.dims == ["station"] and one["b"].data() == [50, 60]
    assert weather.map(lambda a, n: a.add(1))["t"].data() == [[2, 3], [4, 5], [6, 7]]


def test_merge(make, weather):
    more = weather.merge(Dataset({"q": make([1, 2], ["x"], {"x": [10, 20]})}, attrs={"a": 2}))
    assert more.data_vars == ["t", "p", "q"] and more.attrs == {"a": 2}
    with pytest.raises(ValueError, match="exists in both"):
        weather.merge(weather)
    with pytest.raises(ValueError):
        weather.merge(Dataset({"q": make([1, 2, 3], ["x"])}))


def test_where(make):
    d = Dataset({"t": make([1, 2, 3], ["x"]), "h": make([50, 60, 70], ["x"])})
    cond = make([True, False, True], ["x"])
    got = d.where(cond, Dataset({"t": make([-1, -1, -1], ["x"]), "h": make([0, 0, 0], ["x"])}))
    assert got["t"].data() == [1, -1, 3] and got["h"].data() == [50, 0, 70]
    assert d.where(cond, Dataset({"t": make([-1, -1, -1], ["x"])}))["h"].data() == [50, None, 70]
    with pytest.raises(KeyError):
        d.where(Dataset({"t": cond}))


def test_rolling(make, weather):
    d = weather.merge(Dataset({"q": make([1, 2], ["x"], {"x": [10, 20]})}))
    got = d.rolling("time", 2).mean()
    assert got["t"].data() == [[None, None], [2, 3], [4, 5]] and got["q"].data() == [1, 2]
    assert d.rolling("time", 2).sum()["t"].data()[1] == [4, 6]
    with pytest.raises(ValueError):
        d.rolling("zz", 2)


def test_concat(make, weather):
    later = Dataset({"t": make([[7, 8], [9, 10]], ["time", "x"], {"time": [2023, 2024], "x": [10, 20]}), "p": make([[700, 800], [900, 1000]], ["time", "x"], {"time": [2023, 2024], "x": [10, 20]})})
    both = weather.concat(later, "time")
    assert both.sizes == {"time": 5, "x": 2}
    assert both.sel({"time": [2021, 2022, 2023, 2024]})["t"].data() == [[3, 4], [5, 6], [7, 8], [9, 10]]
    assert both.sel({"time": 2023, "x": 20})["p"].item() == 800
    assert both.isel({"x": 1, "time": slice(2, 4)})["t"].data() == [6, 8]
    assert both["t"].isel({"time": [4, 0, 4]}).data() == [[9, 10], [1, 2], [9, 10]]
    assert both.concat(later, "time")["t"].sum().item() == 21 + 34 + 34
    only = both["t"].isel({"time": slice(0, 2)}).cells._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in only  # the other operand is not read
    for bad, dim in ((later, "zz"), (later.drop_vars("p"), "time"), (later.isel({"x": [0]}), "time")):
        with pytest.raises(ValueError, match="Cannot concatenate"):
            weather.concat(bad, dim)


def test_wide_and_sinks(weather):
    rows = weather.wide().orderBy("__i_time", "__i_x").collect()
    assert [(r["t"], r["p"]) for r in rows][:2] == [(1, 100), (2, 200)]
    assert weather.to_records("t").count() == 6 and weather.to_object()["sizes"] == {"time": 3, "x": 2}
    assert '"dims": ["time", "x"]' in weather.to_json() and "time: 3" in repr(weather)
    assert weather.compute()["t"].sum().item() == 21


def test_estimates_and_resolutions(make):
    a = make([[1, 2], [3, 4]], ["time", "lat"], {"time": [0, 24], "lat": [10, 10.5]}, attrs={"_zarr_data_type": "float64", "_coordAttrs": {"time": {"units": "hours since 2000-01-01"}}})
    d = Dataset({"v": a}, coord_attrs={"time": {"units": "hours since 2000-01-01"}})
    assert d.get_size_estimation("v") == 32 and d.get_size_estimation("v", {"time": 0, "lat": {"start": 0, "stop": 1}}) == 8
    got = d.calculate_coordinate_resolutions()
    assert got == {"time": {"value": 1, "type": "daily", "unit": "days"}, "lat": {"resolution": 0.5, "unit": "degrees_north"}}
    assert d.coord_attrs["time"]["resolution_type"] == "daily"
    assert not d.detect_encryption()
    a.attrs["codecs"] = [{"name": "xchacha20poly1305"}]
    assert d.detect_encryption() and d.is_encrypted


def test_streams(make):
    t = make(list(range(50)), ["time"])
    d = Dataset({"t": t, "p": t.add(1)})
    chunks = list(d.sel_stream({}, chunk_size=80 * 10 / (1 << 20) / 10))
    assert len(chunks) == 5 and [c.progress for c in chunks] == [20, 40, 60, 80, 100]
    assert sum((c.data["t"].data() for c in chunks), []) == list(range(50)) and chunks[-1].bytes_processed == chunks[-1].total_bytes
    grid = Dataset({"t": make([[i * 3 + j for j in range(3)] for i in range(20)], ["time", "x"]), "q": make(list(range(20)), ["time"])})
    parts = list(grid.sel_stream({"x": 1, "time": {"start": 2, "stop": 9}}, chunk_size=24 / (1 << 20)))
    assert [c.data["t"].dims for c in parts] == [("time",)] * 3
    assert sum((c.data["t"].data() for c in parts), []) == [i * 3 + 1 for i in range(2, 10)] and sum((c.data["q"].data() for c in parts), []) == list(range(2, 10))
    one = list(t.sel_stream({"time": 7}))
    assert len(one) == 1 and one[0].progress == 100 and one[0].data.item() == 7
    assert [c.data.data() for c in t.sel_stream({"time": [40, 3]}, chunk_size=8 / (1 << 20))] == [[40], [3]]
    with pytest.raises(ValueError):
        list(Dataset({}).sel_stream({}))
    with pytest.raises(ValueError):
        list(t.sel_stream({}, dimension="zz"))


def test_micro_batches(spark, make, tmp_path):
    from labarr.sources.table import write_cells
    from labarr.streaming.chunks import micro_batches

    a = make([1.0, 2.0, 3.0], ["x"])
    write_cells(a, str(tmp_path / "cells"))
    seen = []
    for _ in range(2):
        micro_batches(spark, str(tmp_path / "cells"), a.cells.schema, lambda df, n: seen.append(sorted(r["value"] for r in df.collect())), str(tmp_path / "cp"))
    assert sum(seen, []) and sorted(sum(seen, [])) == [1.0, 2.0, 3.0]
