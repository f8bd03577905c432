"""Random chains of operations against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labarr.operators import DataArray, Dataset
from labarr.sources.loader import from_loader


def build(spark, values, dims, how):
    """The same array from driver data, from a function, and as two halves."""
    if how == "nested":
        return DataArray.from_nested(spark, values, dims)
    if how == "loader":
        return from_loader(spark, dims, values.shape, lambda r: values[tuple(slice(x.start, x.stop) for x in r.values())], block=tuple(max(1, n // 2) for n in values.shape))
    at = max(1, values.shape[0] // 2)
    halves = [Dataset({"v": DataArray.from_nested(spark, part, dims)}) for part in (values[:at], values[at:])]
    labels = {dims[0]: list(range(values.shape[0]))}
    return halves[0].concat(halves[1], dims[0]).assign_coords(labels)["v"]


def pick(rng, n):
    kind = rng.randrange(5)
    if kind == 0:
        return rng.randrange(-n, n)
    if kind == 1:
        return [rng.randrange(-n, n) for _ in range(rng.randrange(1, 4))]
    step = rng.choice([1, 1, 2, -1, -3])
    a, b = sorted(rng.randrange(n + 1) for _ in range(2))
    return slice(a, b, step) if step > 0 else slice(None, None, step)


@pytest.mark.parametrize("seed", range(12))
def test_selection_chains_and_reductions(spark, seed):
    rng = random.Random(seed)
    rank = rng.randrange(1, 4)
    shape = tuple(rng.randrange(2, 7) for _ in range(rank))
    dims = [f"d{k}" for k in range(rank)]
    want = np.random.default_rng(seed).integers(-9, 9, shape).astype(float)
    got = build(spark, want, dims, rng.choice(["nested", "loader", "halves"]))
    left = list(dims)
    for _ in range(3):
        if not left:
            break
        d = rng.choice(left)
        axis = left.index(d)
        n = want.shape[axis]
        if n == 0:
            break
        p = pick(rng, n)
        got = got.isel({d: p})
        want = np.take(want, p, axis) if not isinstance(p, slice) else want[tuple([slice(None)] * axis + [p])]
        if isinstance(p, int):
            left.remove(d)
    assert got.shape == want.shape and got.dims == tuple(left)
    assert got.data() == want.tolist()
    if left:
        d = rng.choice(left)
        axis = left.index(d)
        assert got.sum(d).data() == want.sum(axis).tolist()
        if want.size:
            assert np.allclose(np.array(got.mean(d).data(), float), want.mean(axis))
            assert np.allclose(np.array(got.subtract(got.mean(d)).data(), float), np.moveaxis(want - want.mean(axis, keepdims=True), 0, 0))
    assert got.sum().item() == want.sum()


@pytest.mark.parametrize("seed", range(6))
def test_labels_and_broadcasts(spark, seed):
    rng = random.Random(100 + seed)
    a = np.random.default_rng(seed).normal(size=(rng.randrange(2, 5), rng.randrange(2, 5)))
    b = np.random.default_rng(seed + 1).normal(size=(a.shape[1], rng.randrange(2, 5)))
    labels = {"y": [rng.random() * 100 + k for k in range(a.shape[0])], "x": [f"l{k}" for k in range(a.shape[1])], "z": [10 * k for k in range(b.shape[1])]}
    p = DataArray.from_nested(spark, a, ["y", "x"], {k: labels[k] for k in "yx"})
    q = DataArray.from_nested(spark, b, ["x", "z"], {k: labels[k] for k in "xz"})
    whole = p.multiply(q)
    assert whole.dims == ("y", "x", "z") and np.allclose(np.array(whole.data(), float), a[:, :, None] * b[None])
    some = rng.sample(labels["x"], 2)
    at = [labels["x"].index(s) for s in some]
    assert np.allclose(np.array(whole.sel({"x": some, "z": 10}).data(), float), (a[:, :, None] * b[None])[:, at, 1])
    chosen = DataArray.choose(p.gt(0), q, -1.0)
    assert np.allclose(np.array(chosen.data(), float), np.where(a[:, :, None] > 0, b[None], -1.0))
    rows = whole.records().filter(F.col("x") == some[0]).collect()
    assert len(rows) == a.shape[0] * b.shape[1]
