"""Tissue indicators without columns, against the dense solve."""

import time

import numpy as np
import pytest

from agestack.operators import linear, search
from agestack.operators.arrowhead import arrowhead_weights, fit_arrowhead, with_offsets
from agestack.operators.stats import gram


def made(n, p, tissues, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * 3 + 40
    which = rng.choice(tissues, n, p=np.arange(1, tissues + 1) / np.arange(1, tissues + 1).sum())
    y = x @ rng.normal(size=p) + rng.normal(size=tissues)[which] * 5 + rng.normal(size=n) + 100
    return x, which, y


def dense(x, which, y, alpha, tissues):
    z = np.column_stack([np.ones(len(x)), x, np.eye(tissues)[which], y])
    return linear.ridge_weights(z.T @ z, alpha)


@pytest.mark.parametrize("alpha,tissues,use", [(0.1, 7, None), (100.0, 7, [0, 2]), (1.0, 1, None), (5.0, 60, [1])])
def test_equal_to_the_dense_solve(alpha, tissues, use):
    x, which, y = made(500, 4, tissues)
    z = np.column_stack([np.ones(500), x, y])
    borders = np.array([z[which == t].sum(axis=0) for t in range(tissues)])
    base, w, d = arrowhead_weights(z.T @ z, borders, alpha, None if use is None else np.array(use))
    want_base, want = dense(x if use is None else x[:, use], which, y, alpha, tissues)
    np.testing.assert_allclose(np.concatenate([w, d]), want, atol=1e-9)
    assert base == pytest.approx(want_base, abs=1e-7)


def test_no_penalty_is_refused():
    with pytest.raises(ValueError):
        arrowhead_weights(np.eye(3), np.eye(3), 0.0)


@pytest.fixture(scope="module")
def rows(spark):
    x, which, y = made(900, 3, 12)
    frame = spark.createDataFrame([(f"T{t}", int(i % 4), [float(v) for v in r], float(v)) for i, (t, r, v) in enumerate(zip(which, x, y))],
                                  "Tissue string, fold int, values array<double>, y double")
    return frame.repartition(4).cache(), x, which, y


def test_fit_and_family(rows):
    frame, x, which, y = rows
    stats = gram(frame, ["Tissue"], 3, "y")
    whole = fit_arrowhead(stats, [], 3, [{"alpha": 2.0}])
    r = whole.first()
    base, want = dense(x, which, y, 2.0, 12)
    got = dict(zip(r["tissues"], r["offsets"]))
    np.testing.assert_allclose(r["weights"] + [got[f"T{t}"] for t in range(12)], want, atol=1e-7)
    models = {m["model_key"]: m for m in with_offsets(linear.fit_tissue_family(stats, 3, 2.0, 60), whole, []).collect()}
    assert set(models) == {f"T{t}" for t in range(12)} | {"Global"}
    sizes = np.bincount(which)
    for t in range(12):
        m = models[f"T{t}"]
        if sizes[t] < 60:
            assert m["intercept"] == pytest.approx(base + want[3 + t], abs=1e-5)
            np.testing.assert_allclose(m["weights"], want[:3], atol=1e-7)
        else:
            own = which == t
            z = np.column_stack([np.ones(own.sum()), x[own], y[own]])
            np.testing.assert_allclose(m["weights"], linear.ridge_weights(z.T @ z, 2.0)[1], atol=1e-6)


def test_search_with_and_without_offsets(rows):
    frame, x, which, y = rows
    per = gram(frame, ["fold", "Tissue"], 3, "y").cache()
    pooled = per.groupBy("fold", "i", "j").agg({"v": "sum"}).withColumnRenamed("sum(v)", "v")
    trials = [{"trial": 0, "alpha": 2.0, "use": [0, 1, 2]}, {"trial": 1, "alpha": 2.0, "use": [0, 1, 2], "offsets": True},
              {"trial": 2, "alpha": 50.0, "use": [0], "offsets": True}]
    got = {(r["fold"], r["job"]): r["mae"] for r in search.search_ridge(frame, pooled, 3, trials, "y", 4, per_fold_tissue=per).collect()}
    fold = np.arange(900) % 4
    assert len(got) == 12
    for f in range(4):
        out, own = fold != f, fold == f
        for c in trials:
            xs = x[:, c["use"]]
            if c.get("offsets"):
                base, w = dense(xs[out], which[out], y[out], c["alpha"], 12)
                guess = base + xs[own] @ w[:xs.shape[1]] + w[xs.shape[1]:][which[own]]
            else:
                z = np.column_stack([np.ones(out.sum()), xs[out], y[out]])
                base, w = linear.ridge_weights(z.T @ z, c["alpha"])
                guess = base + xs[own] @ w
            assert got[(f, c["trial"])] == pytest.approx(np.abs(guess - y[own]).mean(), abs=1e-6)


def test_a_thousand_tissues(spark):
    """Linear in tissues: the dense system would have a billion numbers of work for each solve."""
    x, which, y = made(6000, 5, 1000)
    z = np.column_stack([np.ones(6000), x, y])
    borders = np.zeros((1000, 7))
    np.add.at(borders, which, z)
    start = time.perf_counter()
    for alpha in np.geomspace(0.1, 1000, 50):
        arrowhead_weights(z.T @ z, borders, alpha)
    assert time.perf_counter() - start < 5
