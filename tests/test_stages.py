"""The stage jobs: routes must agree, nothing may depend on row order, and reloaded models score alike."""

import pytest
from pyspark.sql import functions as F

from agestack.operators import score
from agestack.plans import stages, standins as t
from agestack.session import scratch_path
from agestack.sources.store import ModelStore
from oracle import SF

TRIALS = [
    {"trial": 0, "alpha": 0.02, "l1": 0.5, "min_cap": 5, "max_cap": 50, "mult": 1.0},
    {"trial": 1, "alpha": 0.05, "l1": 0.7, "min_cap": 5, "max_cap": 20, "mult": 0.8},
]


@pytest.fixture(scope="module")
def inputs(spark):
    return t.samples(spark, SF), t.packed(spark, SF)


def _train(spark, inputs, **kw):
    store = ModelStore(spark, scratch_path(spark, "stage"))
    samples, packed = inputs
    first = stages.train_stage1(store, samples, packed, t.FEATURES, t.hallmark_sites(spark), TRIALS, n_splits=3,
                                min_cohorts=1, **kw)
    return store, first


@pytest.fixture(scope="module")
def narrow(spark, inputs):
    store, first = _train(spark, inputs)
    second = stages.train_stage2(store, TRIALS, n_splits=3, min_cohorts=1)
    third = stages.train_stage3(store, first, second, t.context(spark, SF).drop("Tissue"), min_samples=10, n_splits=3)
    return store, first, second, third


def _by_id(df, col):
    return {r["sample_id"]: r[col] for r in df.select("sample_id", col).collect()}


def test_tables_are_whole(inputs, narrow):
    healthy = inputs[0].filter("Is_Healthy").count()
    _, first, second, third = narrow
    for df, col in ((first, "pred_age"), (second, "pred_resid_H1"), (third, "oof_fused_age")):
        assert df.count() == healthy == df.filter(F.col(col).isNotNull()).count()
    assert third.columns[:7] == ["sample_id", "age", "fused_age", "pred_age_stage1", "stage3_correction", "Tissue", "project_id"]


def test_partitions_do_not_matter(spark, inputs, narrow):
    samples, packed = inputs
    _, again = _train(spark, (samples.repartition(5), packed.repartition(9)))
    a, b = _by_id(narrow[1], "pred_age"), _by_id(again, "pred_age")
    assert a.keys() == b.keys()
    assert max(abs(a[k] - b[k]) for k in a) < 1e-6


def test_solvers_agree(spark, inputs, narrow):
    """The solver is the caller's choice and changes no result."""
    store, wide = _train(spark, inputs, solver="working_set")
    second = stages.train_stage2(store, TRIALS, n_splits=3, min_cohorts=1, solver="working_set")
    for name in ("stage1", "stage2"):
        a, b = (sorted(map(tuple, s.load(f"{name}_coefficients").filter("abs(weight) > 1e-9").select("model_key", "idx", "weight").collect()))
                for s in (narrow[0], store))
        assert [x[:2] for x in a] == [x[:2] for x in b]
        assert max(abs(x[2] - y[2]) for x, y in zip(a, b)) < 1e-6
    for x, y, col in ((narrow[1], wide, "pred_age"), (narrow[2], second, "pred_resid_H1")):
        a, b = _by_id(x, col), _by_id(y, col)
        assert max(abs(a[k] - b[k]) for k in a) < 1e-6


def test_bad_inputs_are_refused(spark, inputs, narrow):
    store, context = narrow[0], t.context(spark, SF).drop("Tissue")
    samples, packed = inputs
    short = packed.withColumn("values", F.when(F.col("sample_id") == packed.first()["sample_id"], F.slice("values", 1, 3)).otherwise(F.col("values")))
    empty = packed.withColumn("values", F.when(F.col("sample_id") != packed.first()["sample_id"], F.col("values")))
    for bad in ((samples.unionByName(samples), packed), (samples, packed.unionByName(packed)), (samples, short), (samples, empty)):
        with pytest.raises(ValueError):
            _train(spark, bad)
        with pytest.raises(ValueError):
            stages.predict_all(store, *bad, context)
    with pytest.raises(ValueError):
        stages.predict_all(store, samples, packed, context.unionByName(context))
    with pytest.raises(ValueError):
        stages.train_stage3(store, narrow[1].unionByName(narrow[1]), narrow[2], context, n_splits=3)


def test_scoring_in_parts_agrees(spark, inputs, narrow, monkeypatch):
    store, context = narrow[0], t.context(spark, SF).drop("Tissue")
    whole = _by_id(stages.predict_all(store, *inputs, context), "fused_age")
    monkeypatch.setattr(score, "MODEL_NUMBERS", 70)
    parts = _by_id(stages.predict_all(store, *inputs, context), "fused_age")
    assert whole.keys() == parts.keys() and len(whole) == inputs[0].count()
    assert max(abs(whole[k] - parts[k]) for k in whole) < 1e-9


def test_stages_one_by_one_agree_with_the_whole(spark, inputs, narrow):
    from agestack.operators.align import join_context, join_stages
    from agestack.operators.normalise import expert_columns

    store, context = narrow[0], t.context(spark, SF).drop("Tissue")
    one, two = stages.predict_stage1(store, *inputs), stages.predict_stage2(store, inputs[1])
    joined = join_context(join_stages(one, two, expert_columns(two.columns)), context, training=False)
    a = _by_id(stages.predict_stage3(store, joined), "fused_age")
    b = _by_id(stages.predict_all(store, *inputs, context), "fused_age")
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-9


def test_in_sample_scores_match_reloaded_models(spark, narrow):
    store, _, second, third = narrow
    from agestack.operators.align import join_context

    ready = join_context(second, t.context(spark, SF).drop("Tissue"), training=False)
    a, b = _by_id(stages.predict_stage3(store, ready), "pred_residual_stage3"), _by_id(third, "stage3_correction")
    assert max(abs(a[k] - b[k]) for k in b) < 1e-9


def test_unseen_tissue_and_missing_columns(narrow):
    store, _, second, _ = narrow
    alone = second.withColumn("Tissue", F.lit("never seen")).drop("pred_resid_H2")
    bare = second.drop("Tissue", "pred_resid_H2")
    a, b = (_by_id(stages.predict_stage3(store, d), "pred_residual_stage3") for d in (alone, bare))
    assert a == b and len(a) == second.count()  # both take the global model


def test_batch_medians(spark, inputs, narrow):
    out = stages.predict_stage1(narrow[0], *inputs, batch_medians=True)
    assert out.count() == inputs[0].count()


def test_residual_target_and_search(spark, inputs, narrow):
    store, first = _train(spark, inputs, halving=True, orthogonal=False, healthy_only=False)
    assert first.count() == inputs[0].count()
    second = stages.train_stage2(store, TRIALS, n_splits=3, min_cohorts=1, target="residual")
    trials = [{"trial": i, "alpha": a, "use_pcs": i % 2 == 0, "use_tissue_dummies": i > 1} for i, a in enumerate((0.1, 1.0, 10.0, 100.0))]
    third = stages.train_stage3(store, first, second, t.context(spark, SF).drop("Tissue"), candidates=trials, min_samples=10, n_splits=3)
    assert third.count() == first.count()
    chosen = store.load_settings("stage3_settings")
    assert chosen["alpha"] in (0.1, 1.0, 10.0, 100.0)
    out = stages.predict_all(store, *inputs, t.context(spark, SF).drop("Tissue"))
    assert out.count() == inputs[0].count()


def test_large_family_is_joined(spark, narrow, monkeypatch):
    """Beyond the number of weights a task may be sent, models are joined to the rows."""
    store, _, second, _ = narrow
    shipped = _by_id(stages.predict_stage3(store, second), "pred_residual_stage3")
    monkeypatch.setattr(stages, "few_numbers", lambda models: False)
    joined = _by_id(stages.predict_stage3(store, second), "pred_residual_stage3")
    assert max(abs(shipped[k] - joined[k]) for k in shipped) < 1e-9


def test_default_search(spark, inputs):
    """Without candidates a search draws its own, as many as asked for."""
    store = ModelStore(spark, scratch_path(spark, "default"))
    first = stages.train_stage1(store, *inputs, t.FEATURES, t.hallmark_sites(spark), n_splits=3, min_cohorts=1, n_trials=3,
                                space={"alpha": ("log", 0.01, 0.1), "l1": ("uniform", 0.4, 0.6), "min_cap": ("int", 5, 6), "max_cap": ("int", 20, 30),
                                       "mult": ("uniform", 0.8, 1.0)})
    assert first.filter("pred_age is not null").count() == inputs[0].filter("Is_Healthy").count()
    assert store.load("stage1_trials").select("trial").distinct().count() == 3


def test_unit_scale_and_medians_of_each_training_set(spark, inputs, narrow):
    """Both options end to end: what is stored, and that scoring folds it in."""
    import numpy as np

    from agestack.functions.scalar import AGE_TARGET

    store, first = _train(spark, inputs, standardize=True, fold_medians=True)
    second = stages.train_stage2(store, TRIALS, n_splits=3, min_cohorts=1)
    assert second.count() == first.count() == narrow[1].count()
    plain, other = _by_id(narrow[1], "pred_age"), _by_id(first, "pred_age")
    assert max(abs(plain[k] - other[k]) for k in plain) > 1e-3

    rows = store.load("training").select("sample_id", "fold", "values").collect()
    x = np.array([[np.nan if v is None else v for v in r["values"]] for r in rows], dtype=float)
    fold = np.array([r["fold"] for r in rows])
    for r in store.load("fold_medians").collect():
        own = x[fold != r["held_out"], r["idx"]]
        own = own[~np.isnan(own)]
        assert r["fill"] == (np.median(own) if len(own) else 0.0)

    fills = {r["idx"]: r["fill"] for r in store.load("features").collect()}
    unit = {r["idx"]: (r["weight"], r["mean"], r["scale"]) for r in
            store.load("stage1_coefficients").join(store.load("stage1_scaling"), ["model_key", "idx"]).collect()}
    assert len(unit) == len(t.FEATURES)
    base = store.load("stage1_intercepts").first()["intercept"]
    got = _by_id(stages.predict_stage1(store, *inputs), "pred_age_stage1")
    inverse = AGE_TARGET.inverse_array
    for r in inputs[1].limit(20).collect():
        cells = [fills[i] if v is None else v for i, v in enumerate(r["values"])]
        want = inverse(np.array([base + sum(w * (cells[i] - m) / s for i, (w, m, s) in unit.items())]))[0]
        assert got[r["sample_id"]] == pytest.approx(want, abs=1e-4)
    with pytest.raises(ValueError):
        _train(spark, inputs, standardize=True, solver="working_set")


def test_folds_of_choice(spark, inputs):
    """Stage 1 trains on the folds it is told to make."""
    from agestack.operators.folds import stratified_folds

    store, first = _train(spark, inputs, make_folds=stratified_folds)
    data = store.load("training")
    made = {r["project_id"]: r["fold"] for r in stratified_folds(data, 3, 42).collect()}
    assert made == {r["project_id"]: r["fold"] for r in data.select("project_id", "fold").distinct().collect()}
    assert first.filter("pred_age is not null").count() == data.count()
