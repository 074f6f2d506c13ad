"""Medians from grids of counts against numpy, bit by bit."""

import numpy as np
import pytest

from agestack.operators import grids, impute


def frame(spark, x, kind, fold=None):
    rows = [(i, None if fold is None else int(fold[i]), [None if i % 7 == 3 and np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, f"sample_id long, fold int, values array<{kind}>").repartition(3)


def made(n, p, seed=0):
    """Ties, infinities, signed zeros, gaps, very small and very large numbers, an empty and a constant column."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * 10.0 ** rng.integers(-30, 30, size=p)
    x[:, 0] = np.nan
    x[:, 1] = 0.5
    x[:, 2] = rng.integers(-2, 3, n)
    x[:, 3] = np.where(rng.random(n) < 0.6, np.inf, x[:, 3])
    x[:, 4] = np.where(rng.random(n) < 0.7, -np.inf, x[:, 4])
    x[:, 5] = np.where(rng.random(n) < 0.5, -0.0, 1e-40)
    x[rng.random((n, p)) < 0.1] = np.nan
    return x


def medians(x):
    with np.errstate(invalid="ignore"), pytest.warns(RuntimeWarning):
        return np.nanmedian(x.astype(np.float64), axis=0)


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("n,p,grid", [(401, 9, 1 << 22), (90, 40, 1 << 12), (7, 6, 1 << 9)])
def test_equal_to_numpy(spark, monkeypatch, kind, n, p, grid):
    monkeypatch.setattr(grids, "GRID", grid)
    x = made(n, p, n).astype(np.float32 if kind == "float" else np.float64)
    got = grids.grid_medians(frame(spark, x, kind), p)
    assert got.shape == (1, p)
    np.testing.assert_array_equal(got[0], medians(x))


@pytest.mark.parametrize("grid", [1 << 22, 1 << 11])
def test_outside_each_fold(spark, monkeypatch, grid):
    monkeypatch.setattr(grids, "GRID", grid)
    x = made(300, 8).astype(np.float32)
    fold = np.random.default_rng(5).choice(4, 300, p=[0.7, 0.1, 0.15, 0.05])
    got = grids.grid_medians(frame(spark, x, "float", fold), 8, "fold", 4)
    assert got.shape == (5, 8)
    for h in range(4):
        np.testing.assert_array_equal(got[h], medians(x[fold != h]))
    np.testing.assert_array_equal(got[4], medians(x))


def test_no_rows(spark):
    assert np.isnan(grids.grid_medians(frame(spark, np.zeros((0, 3)), "float"), 3)).all()
    assert impute.packed_fills(frame(spark, np.zeros((0, 3)), "float"), 3) == [0.0, 0.0, 0.0]


def test_rows_take_the_fills_of_their_key(spark):
    rows = frame(spark, np.array([[np.nan, 1.0], [2.0, np.nan], [np.nan, np.nan]]), "double", [0, 1, 2])
    out = impute.impute_packed(rows, np.array([[10.0, 11.0], [20.0, 21.0], [30.0, 31.0]]), "fold").collect()
    assert sorted((r.fold, r["values"]) for r in out) == [(0, [10.0, 1.0]), (1, [2.0, 21.0]), (2, [30.0, 31.0])]
