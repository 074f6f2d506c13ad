"""Fits against numpy re-computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from agestack.operators import linear, score
from agestack.operators.selection import cell_correlation, packed_correlation
from agestack.operators.stats import gram, moments

P = 6


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, P)).astype(np.float32).astype(float)
    x[:, 5] = 0.7  # constant
    y = x[:, 0] * 2 - x[:, 1] + 0.3 * rng.normal(size=600) + 4
    tissue = np.where(np.arange(600) % 3 == 0, "hot", np.where(np.arange(600) % 40 == 1, "rare", "other"))
    df = spark.createDataFrame([(str(i), str(tissue[i]), [float(v) for v in x[i]], float(y[i])) for i in range(600)],
                               "sample_id string, Tissue string, values array<float>, y double").repartition(5).cache()
    return df, x, y, tissue


def _ridge(x, y, alpha):
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    return y.mean() - x.mean(0) @ w, w


def test_ridge(data):
    df, x, y, _ = data
    got = linear.fit_ridge(gram(df, [], P, "y"), [], P, 2.5).first()
    base, w = _ridge(x, y, 2.5)
    np.testing.assert_allclose(got["weights"], w, atol=1e-6)
    assert got["intercept"] == pytest.approx(base, abs=1e-6)


def test_elastic_net_is_optimal(data):
    """The sub-gradient conditions of the objective hold."""
    df, x, y, _ = data
    alpha, l1 = 0.2, 0.6
    got = linear.fit_elastic_net(gram(df, [], P, "y"), [], P, alpha, l1).first()
    w = np.array(got["weights"])
    slope = x.T @ (y - x @ w - got["intercept"]) / len(y) - alpha * (1 - l1) * w
    for j in range(P):
        if abs(w[j]) > 1e-12:
            assert slope[j] == pytest.approx(alpha * l1 * np.sign(w[j]), abs=1e-5)
        else:
            assert abs(slope[j]) <= alpha * l1 + 1e-6
    assert (np.abs(w) < 1e-12).any() and (np.abs(w) > 0.1).any()


def test_wide_route_finds_the_same_optimum(data):
    """Guards the penalty mapping of the gradient route."""
    df, _, _, _ = data
    for alpha, l1 in ((0.2, 0.6), (0.05, 0.1)):
        a = linear.fit_elastic_net(gram(df, [], P, "y"), [], P, alpha, l1).first()
        b = linear.fit_elastic_net_wide(df, "y", alpha, l1).first()
        np.testing.assert_allclose(a["weights"], b["weights"], atol=2e-4)
        assert a["intercept"] == pytest.approx(b["intercept"], abs=1e-3)


def test_wide_ridge(data):
    df, x, y, _ = data
    np.testing.assert_allclose(linear.fit_ridge_wide(df, "y", 2.5).first()["weights"], _ridge(x, y, 2.5)[1], atol=1e-3)


def test_tissue_family_and_fallback(data):
    df, x, y, tissue = data
    models = linear.fit_tissue_family(gram(df, ["Tissue"], P, "y"), P, 1.0, min_samples=50).cache()
    got = {r["model_key"]: r for r in models.collect()}
    assert set(got) == {"hot", "other", "Global"}
    np.testing.assert_allclose(got["hot"]["weights"], _ridge(x[tissue == "hot"], y[tissue == "hot"], 1.0)[1], atol=1e-6)
    np.testing.assert_allclose(got["Global"]["weights"], _ridge(x, y, 1.0)[1], atol=1e-6)
    joined = {r["sample_id"]: r["correction"] for r in score.score_with_fallback(df, models).collect()}
    arrays = score.model_arrays([r.asDict() for r in models.collect()], ["model_key"], P)
    shipped = score.score_packed(df, arrays, ["correction"], P, ["sample_id"], ["Tissue"], lambda k: ("Global",))
    for r in shipped.collect():
        assert r["correction"] == pytest.approx(joined[r["sample_id"]], abs=1e-9)
    i = int(np.flatnonzero(tissue == "rare")[0])
    assert joined[str(i)] == pytest.approx(got["Global"]["intercept"] + x[i] @ got["Global"]["weights"], abs=1e-6)


def test_no_model_gives_no_correction(data):
    df, *_ = data
    empty = linear.fit_tissue_family(gram(df, ["Tissue"], P, "y"), P, 1.0).limit(0)
    assert score.score_with_fallback(df, empty).filter("correction <> 0").count() == 0


def test_correlation(data):
    df, x, y, _ = data
    got = {r["idx"]: r["r"] for r in packed_correlation(df, P, "y", [float(np.float32(0.7))] * P).collect()}
    for j in range(5):
        assert got[j] == pytest.approx(np.corrcoef(x[:, j], y)[0, 1], abs=1e-6)
    assert got[5] == pytest.approx(0.0, abs=1e-9)  # a constant feature, not an error
    cells = df.select("y", F.posexplode("values").alias("feature", "value"))
    for r in cell_correlation(cells, "y").collect():
        assert r["r"] == pytest.approx(got[r["feature"]], abs=1e-6)


def test_correlation_of_one_row_is_zero(spark):
    df = spark.createDataFrame([([1.0, 2.0], 3.0)], "values array<float>, y double")
    assert [r["r"] for r in packed_correlation(df, 2, "y").collect()] == [0.0, 0.0]


def test_moments_skip_missing_cells(spark):
    df = spark.createDataFrame([([1.0, None], 1.0), ([3.0, 5.0], 2.0), ([float("nan"), 7.0], 4.0)], "values array<float>, y double")
    got = {r["idx"]: r.asDict() for r in moments(df, [], 2, "y").collect()}
    assert (got[0]["n"], got[0]["sx"], got[0]["sy"], got[0]["sxy"]) == (2, 4, 3, 7)
    assert (got[1]["n"], got[1]["sx"], got[1]["sy"], got[1]["sxy"]) == (2, 12, 6, 38)


def test_top_and_active(spark):
    df = spark.createDataFrame([("m", 0, 0.5), ("m", 1, -2.0), ("m", 2, 0.0), ("m", 3, 2.0)], "model_key string, idx int, weight double")
    assert [r["idx"] for r in linear.top_coefficients(df, ["model_key"], 2).orderBy("rn").collect()] == [1, 3]
    assert linear.active(df).count() == 3


def test_no_active_feature_scores_the_intercept(spark):
    cells = spark.createDataFrame([("s", "f", 1.0)], "sample_id string, feature string, value double")
    weights = spark.createDataFrame([("f", 0.0, 1.0, 0.0)], "feature string, mean double, scale double, weight double")
    assert score.score_cells(cells, weights, 2.5, cells).first()["score"] == 2.5


def test_unit_scale_is_a_congruence(data):
    """Statistics of raw features, solved at unit scale, give what scaled features give; a constant feature keeps scale 1."""
    df, x, y, _ = data
    raw = x * [1.0, 50.0, 0.01, 1.0, 7.0, 1.0] + [0, 3.0, 0, -2.0, 100.0, 0]
    z = lambda a: np.column_stack([np.ones(len(a)), a, y])
    total = z(raw).T @ z(raw)
    mean, scale = linear.unit_scales(total)
    sd = raw.std(axis=0)
    sd[5] = 1.0
    np.testing.assert_allclose(scale, sd, rtol=1e-9)
    np.testing.assert_allclose(mean, raw.mean(axis=0))
    unit = (raw - raw.mean(axis=0)) / sd
    for solve, args in ((linear.ridge_weights, (2.5,)), (linear.elastic_net_weights, (0.05, 0.5))):
        base, w = solve(total, *args, standardize=True)
        unit_base, u = solve(z(unit).T @ z(unit), *args)
        np.testing.assert_allclose(w * sd, u, atol=1e-7)
        assert base + raw[3] @ w == pytest.approx(unit_base + unit[3] @ u, abs=1e-6)


def test_scale_table(data):
    df, x, _, tissue = data
    got = {(r["Tissue"], r["idx"]): (r["mean"], r["scale"]) for r in linear.scale_table(gram(df, ["Tissue"], P, "y"), ["Tissue"]).collect()}
    assert len(got) == 3 * P
    for (name, i), (mean, scale) in got.items():
        own = x[tissue == name, i]
        assert mean == pytest.approx(own.mean(), abs=1e-6) and scale == pytest.approx(own.std() if i < 5 else 1.0, abs=1e-6)
    assert linear.scale_table(gram(df, [], P, "y"), []).count() == P


def test_path_gives_the_weights_of_single_jobs():
    """Correlated features, more of them than rows, penalties from none to all weights: same optimum, conditions hold."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 8))
    x = np.hstack([base, base @ rng.normal(size=(8, 92)) + 0.3 * rng.normal(size=(60, 92))])
    y = x[:, 0] - 2 * x[:, 20] + rng.normal(size=60)
    z = np.column_stack([np.ones(60), x, y])
    total = z.T @ z
    jobs = [{"alpha": a, "l1": r} for a in (0.01, 1000.0, 0.3, 0.05, 1.0, 0.3) for r in (0.9, 0.4)]
    for use, unit in ((None, False), (np.arange(3, 40), True)):
        path = linear.elastic_net_path(total, jobs, 20_000, use=use, standardize=unit)
        for job, (b, w) in zip(jobs, path):
            base_b, base_w = linear.elastic_net_weights(total, job["alpha"], job["l1"], 20_000, use=use, standardize=unit)
            np.testing.assert_allclose(w, base_w, atol=2e-6)
            assert b == pytest.approx(base_b, abs=1e-5)
            if not unit:
                slope = x.T @ (y - x @ w - b) / 60 - job["alpha"] * (1 - job["l1"]) * w
                bound = job["alpha"] * job["l1"]
                assert (np.abs(slope) <= bound + 1e-6).all()
                np.testing.assert_allclose(slope[w != 0], bound * np.sign(w[w != 0]), atol=1e-6)
    assert not path[2][1].any() and path[0][1].any()


def test_fifty_trials_on_five_sets_are_fifty_tasks(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), float(rng.normal()), [float(v) for v in rng.normal(size=6)]) for k in range(5) for _ in range(40)]
    df = spark.createDataFrame(rows, "held_out int, y double, values array<double>")
    stats = gram(df, ["held_out"], 6, "y")
    alphas = np.geomspace(1e-3, 1.0, 50)
    jobs = [{"trial": int(t), "held_out": h, "alpha": float(alphas[t]), "l1": 0.2 + 0.01 * int(t), "use": None if t % 2 else (0, 2, 5)}
            for t in range(50) for h in range(6)]
    fitted = linear.fit_paths(stats, ["held_out"], 6, jobs)
    tasks = fitted.select("held_out", "trial", F.spark_partition_id().alias("task")).collect()
    assert len(tasks) == 250 and {r["held_out"] for r in tasks} == set(range(5))  # the sixth set has no rows
    sizes = {}
    for r in tasks:
        sizes[r["task"]] = sizes.get(r["task"], 0) + 1
    assert len(sizes) >= 50 and max(sizes.values()) <= linear.PATH_JOBS
    plain = {(r["held_out"], r["trial"]): r for r in linear.solve_per_key(
        stats, ["held_out"], 6, jobs, lambda t, c: linear.elastic_net_weights(t, c["alpha"], c["l1"], use=None if c["use"] is None else np.array(c["use"]))).collect()}
    for r in fitted.collect():
        np.testing.assert_allclose(r["weights"], plain[r["held_out"], r["trial"]]["weights"], atol=1e-7)
        assert r["n"] == 40
    assert linear.fit_paths(stats, ["held_out"], 6, []).count() == 0
