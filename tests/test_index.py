from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labarr.plans.index import Index, LabelError


def test_exact_and_missing():
    x = Index([10, 20, 30])
    assert [x.find(v) for v in (10, 20, 30)] == [0, 1, 2]
    with pytest.raises(LabelError, match="Coordinate value '25' not found in dimension 'x'"):
        x.find(25, "x")
    assert Index(["a", "b"]).find("b") == 1


@pytest.mark.parametrize(("labels", "bad"), [([0, 1000], [0.5, 1e-9]), ([0, 1e-8], [5e-10])])
def test_rounding_noise_matches_but_real_differences_do_not(labels, bad):
    for v in labels:
        assert Index(labels).find(v) == labels.index(v)
    for v in bad:
        with pytest.raises(LabelError):
            Index(labels).find(v)
    assert Index([0.1 * i for i in range(10)]).find(0.3) == 3


def test_nearest_ties_go_to_the_lower_position_and_ends_clamp():
    x = Index([10, 20, 30, 40, 50, 60, 70, 80, 90, 100])
    assert [x.find(v, "", "nearest") for v in (55, 25, 95, 0, 200)] == [4, 1, 8, 0, 9]
    down = Index([100, 90, 80, 70, 60, 50, 40, 30, 20, 10])
    assert [down.find(v, "", "nearest") for v in (55, 75)] == [4, 2]
    assert Index.range(10, 100, -10).find(55, "", "nearest") == 4


def test_fill_both_ways():
    x = Index([0, 5, 10, 15, 20])
    assert [x.find(v, "", "ffill") for v in (7, 12, 10)] == [1, 2, 2]
    assert [x.find(v, "", "bfill") for v in (7, 12)] == [2, 3]
    assert x.find(12, "", "pad") == 2 and x.find(12, "", "backfill") == 3
    with pytest.raises(LabelError, match="No coordinate <= -5"):
        x.find(-5, "x", "ffill")
    with pytest.raises(LabelError, match="No coordinate >= 25"):
        x.find(25, "x", "bfill")
    down = Index([30, 20, 10])
    assert (down.find(25, "", "ffill"), down.find(25, "", "bfill")) == (0, 1)


def test_tolerance():
    x = Index([10, 20, 30])
    assert x.find(22, tolerance=3) == 1
    with pytest.raises(LabelError, match="not found"):
        x.find(25, tolerance=2)
    assert Index([0, 10, 20]).find(13, "", "ffill", 5) == 1
    with pytest.raises(LabelError, match="within tolerance"):
        Index([0, 10, 20]).find(13, "", "ffill", 2)


def test_methods_need_numbers_or_dates():
    with pytest.raises(TypeError, match="numeric or Date coordinates"):
        Index(["a", "b"]).find("a", "", "nearest")


def test_times_are_utc_and_strict():
    hours = Index([datetime(2021, 1, 1, h) for h in range(24)])
    for text in ("2021-01-01T12:00:00", "2021-01-01t12:00:00", "2021-01-01 12:00:00", "2021-01-01 17:00:00 +05:00", "2021-01-01T12:00:00Z"):
        assert hours.find(text) == 12
    assert hours.find("2021-01-01") == 0
    assert hours.find("2021-01-01T02:20:00", "", "nearest") == 2
    assert hours.find("2021-01-01T02:20:00", "", "bfill") == 3
    for text in ("2021-02-30T00:00:00+00:00", "2021-01-01 00:00:00 garbage", "no date"):
        with pytest.raises(LabelError, match="not found"):
            hours.find(text)
    texts = Index([f"2021-01-01T{h:02d}:00:00" for h in range(24)])
    assert texts.find(datetime(2021, 1, 1, 8)) == 8
    with pytest.raises(LabelError):
        Index(["2021-01-01-A", "2021-01-01-B"]).find(datetime(2021, 1, 1))


def test_cf_numbers_and_texts():
    x = Index([0, 21600, 43200], {"units": "seconds since 1970-01-01"})
    assert x.find("1970-01-01T01:00:00-05:00") == 1
    months = Index([0, 1], {"units": "months since 2000-01-01", "calendar": "noleap"})
    with pytest.raises(LabelError):
        months.find(datetime(2000, 1, 31))
    even = Index(["2000-02-29T00:00:00.000Z", "2000-02-30T00:00:00", "2000-03-01T00:00:00.000Z"], {"units": "days since 2000-01-01", "calendar": "360_day"})
    assert even.find("2000-02-29T06:00:00", "", "nearest") == 0
    assert even.find("2000-02-30T18:00:00", "", "nearest") == 2
    cut = Index(["1582-10-04T00:00:00.000Z", "1582-10-15T00:00:00.000Z"], {"units": "days since 1582-10-01", "calendar": "standard"})
    assert cut.find("1582-10-04T18:00:00", "", "nearest") == 1
    assert cut.find("1582-10-04T06:00:00", "", "nearest") == 0
    fine = Index(["2000-01-01T00:00:00.000001", "2000-01-01T00:00:00.000500"], {"units": "microseconds since 2000-01-01"})
    assert fine.find("2000-01-01T00:00:00.000500") == 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=12), st.integers(-60, 60), st.booleans())
def test_lookup_equals_a_linear_scan(values, target, down):
    labels = sorted(values, reverse=down)
    x = Index([float(v) for v in labels])
    assert x.find(target, "", "nearest") == min(range(len(labels)), key=lambda i: (abs(labels[i] - target), i))
    before = [i for i, v in enumerate(labels) if (v >= target if x.direction < 0 else v <= target)]
    if before:
        assert x.find(target, "", "ffill") == max(before)
    else:
        with pytest.raises(LabelError):
            x.find(target, "", "ffill")


def test_take_and_equality():
    x = Index.range(10, 5, 2)
    assert x.take(range(2, 8, 2)).labels == [9, 13, 17] and x.take([9, 0, 0]).labels == [23, 5, 5]
    assert x == Index([5 + 2 * i for i in range(10)]) and x != Index.range(10)
    assert len(Index([])) == 0
