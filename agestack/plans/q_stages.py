"""Queries: assembly for scoring, the trained stages, their stores and end-to-end scoring.

Training runs once per session and input folder; the queries read what it stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.metrics import regression_metrics
from ..functions.scalar import AGE_TARGET, age_to_scale
from ..operators import align, folds, linear
from ..operators.impute import impute_packed
from ..operators.normalise import expert_columns
from ..operators.search import ELASTIC_NET_SPACE, PARAMS, RIDGE_SPACE, random_candidates, sampled_fold_stats, search_elastic_net, trial_scores
from ..operators.stats import gram
from ..session import scratch_path, settle
from ..sources.store import ModelStore
from ..sources.tables import save_predictions
from . import stages, standins as t
from .assembly import assemble, assemble_files
from .registry import query, rounded

N_TRIALS = 6
_stores: dict[tuple, ModelStore] = {}


def _trials(spark: SparkSession, space: dict, n: int = N_TRIALS) -> list[dict]:
    return [r.asDict() for r in random_candidates(spark, n, space, 42).orderBy("trial").collect()]


def _context(spark, sf) -> DataFrame:
    return t.context(spark, sf).drop("Tissue")


def trained(spark: SparkSession, sf: str) -> ModelStore:
    """All three stages on the whole stand-in tables."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _stores:
        store = ModelStore(spark, scratch_path(spark, "clock"))
        trials = _trials(spark, ELASTIC_NET_SPACE)
        first = stages.train_stage1(store, t.samples(spark, sf), t.packed(spark, sf), t.FEATURES,
                                    t.hallmark_sites(spark), trials)
        second = stages.train_stage2(store, trials, halving=True)
        stages.train_stage3(store, first, second, _context(spark, sf), candidates=_trials(spark, RIDGE_SPACE), min_samples=40)
        _stores[key] = store
    return _stores[key]


@query("prd5_assemble_inputs", f"""WITH {t.FILLED_SQL}
SELECT sample_id, feature, dim AS idx, round(value, 6) + 0.0 AS value FROM filled""")
def prd5(spark, sf):
    """Three wide modality tables and the components -> packed in model order -> imputed (and unpacked, to compare)."""
    wide = {m: t.wide_modality(spark, sf, m) for m in ("beta", "chalm", "camda")}
    made = assemble(t.samples(spark, sf), wide, t.gappy_context(spark, sf), t.feature_index(spark))
    back = align.unpack(impute_packed(made.packed, t.fills(spark, sf)), t.FEATURES)
    return back.select("sample_id", "feature", "idx", rounded("value").alias("value"))


#: Each modality lacks other samples; some samples are in none.
PRESENT = {"beta": "sample_id % 5 <> 2", "chalm": "sample_id % 3 = 0", "camda": "sample_id % 7 > 3"}
_PRESENT_SQL = " OR ".join(f"(modality = '{m}' AND {c.replace('sample_id', 'CAST(sample_id AS BIGINT)')})" for m, c in PRESENT.items())


def _partial(spark, sf):
    wide = {m: t.wide_modality(spark, sf, m).filter(c) for m, c in PRESENT.items()}
    ages = t.samples(spark, sf).withColumn("Age", F.when(F.expr("sample_id % 13 <> 1"), F.col("Age")))
    return assemble(ages, wide, samples=ages)


@query("prd5_assemble_partial", f"""WITH {t.CELLS_SQL}, held AS (SELECT * FROM cells WHERE {_PRESENT_SQL}),
numbered AS (SELECT feature, CAST(row_number() OVER (ORDER BY feature) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT feature FROM held)),
kept AS (SELECT DISTINCT sample_id FROM held WHERE CAST(sample_id AS BIGINT) % 13 <> 1)
SELECT sample_id, feature, idx, round(value, 6) + 0.0 AS value
FROM kept CROSS JOIN numbered LEFT JOIN held USING (sample_id, feature)""")
def prd5_partial(spark, sf):
    made = _partial(spark, sf)
    back = align.unpack(made.packed, made.names())
    return back.select("sample_id", "feature", "idx", rounded(F.col("value").cast("double")).alias("value"))


@query("jn2_excluded_ids", f"""WITH {t.CELLS_SQL}, held AS (SELECT DISTINCT sample_id FROM cells WHERE {_PRESENT_SQL})
SELECT sample_id, CASE WHEN s.sample_id IS NULL THEN 'no features' ELSE 'no age' END AS reason
FROM samples a LEFT JOIN held s USING (sample_id) WHERE s.sample_id IS NULL OR CAST(a.sample_id AS BIGINT) % 13 = 1""")
def jn2_excluded(spark, sf):
    return _partial(spark, sf).excluded


def _training(spark, sf):
    rows = t.packed(spark, sf, with_meta=True).withColumn("y", age_to_scale(F.col("Age")))
    fills = t.fills(spark, sf)
    return rows, fills


def _weights(models, keys):
    table = linear.coefficient_table(models, t.FEATURES, keys)
    return table.select(*keys, "feature", rounded("weight").alias("weight"))


_MODEL_SQL = f"""WITH {t.FILLED_SQL}
SELECT sample_id, feature, dim AS idx, round(value, 6) + 0.0 AS value FROM filled"""


def _files(spark, sf, conditions=None):
    paths = {}
    for modality in ("beta", "chalm", "camda"):
        wide = t.wide_modality(spark, sf, modality).filter((conditions or {}).get(modality, "true"))
        paths[modality] = save_predictions(wide, scratch_path(spark, modality) + ".parquet")
    return paths


@query("prd5_assemble_files", _MODEL_SQL)
def prd5_files(spark, sf):
    """Three modality files, read by column tiles, and the components -> packed in model order -> imputed."""
    made = assemble_files(t.samples(spark, sf), _files(spark, sf), t.gappy_context(spark, sf), t.feature_index(spark))
    back = align.unpack(impute_packed(made.packed, t.fills(spark, sf)), t.FEATURES)
    return back.select("sample_id", "feature", "idx", rounded("value").alias("value"))


@query("prd5_assemble_files_excluded", f"""WITH {t.CELLS_SQL}, held AS (SELECT sample_id, count(value) AS n FROM cells WHERE {_PRESENT_SQL} GROUP BY sample_id)
SELECT a.sample_id, CASE WHEN s.sample_id IS NULL THEN 'no features' WHEN CAST(a.sample_id AS BIGINT) % 13 = 1 THEN 'no age' END AS reason,
       CASE WHEN CAST(a.sample_id AS BIGINT) % 13 <> 1 THEN s.n END AS n_values
FROM samples a LEFT JOIN held s USING (sample_id)""")
def prd5_files_excluded(spark, sf):
    """Files that lack samples: the reason an id is excluded for, or the numbers its packed row holds."""
    ages = t.samples(spark, sf).withColumn("Age", F.when(F.expr("sample_id % 13 <> 1"), F.col("Age")))
    made = assemble_files(ages, _files(spark, sf, PRESENT), samples=ages)
    held = F.size(F.filter("values", lambda x: x.isNotNull())).cast("long")
    return made.packed.select("sample_id", held.alias("n_values")).join(made.excluded, "sample_id", "full").select("sample_id", "reason", "n_values")


@query("fit1_elastic_net")
def fit1(spark, sf):
    """All 64 features, whole table."""
    rows, fills = _training(spark, sf)
    return _weights(linear.fit_elastic_net(gram(rows, [], t.DIMS, "y", fills), [], t.DIMS, 0.005, 0.5), [])


@query("fit1_elastic_net_wide")
def fit1_wide(spark, sf):
    """The same fit through gradient aggregation; must agree with ``fit1_elastic_net``."""
    rows, fills = _training(spark, sf)
    model = linear.fit_elastic_net_wide(settle(impute_packed(rows, fills).select("values", "y")), "y", 0.005, 0.5)
    return linear.coefficient_table(model, t.FEATURES, []).select("feature", rounded("weight", 4).alias("weight"))


@query("fit2_ridge")
def fit2(spark, sf):
    rows, fills = _training(spark, sf)
    return _weights(linear.fit_ridge(gram(rows, ["Tissue"], t.DIMS, "y", fills), ["Tissue"], t.DIMS, 1.0), ["Tissue"])


@query("fit4_hallmark_experts")
def fit4(spark, sf):
    """Final weights of all experts, non-zero ones only."""
    coefficients = trained(spark, sf).load("stage2_coefficients")
    return linear.active(coefficients).select("model_key", "feature", rounded("weight").alias("weight"))


def _prepared(spark, sf):
    rows, fills = _training(spark, sf)
    samples = t.samples(spark, sf)
    data = settle(folds.with_folds(rows, folds.balanced_folds(samples, 5, 42)))
    candidates = random_candidates(spark, N_TRIALS, ELASTIC_NET_SPACE, 42)
    sampled = sampled_fold_stats(data, t.DIMS, "y", candidates, fills=fills)
    return data, [r.asDict() for r in candidates.collect()], sampled


@query("sel1_search_objective")
def sel1(spark, sf):
    """Held-out MAE in years of every candidate in every fold."""
    data, candidates, sampled = _prepared(spark, sf)
    report = search_elastic_net(data, candidates, sampled)
    return report.select("trial", "fold", "target_n", rounded("mae").alias("mae"))


@query("sel3_best_model")
def sel3(spark, sf):
    """Mean score of every stage-1 trial."""
    scores = trial_scores(trained(spark, sf).load("stage1_trials"), PARAMS)
    return scores.select("trial", "n_folds", *[rounded(c).alias(c) for c in ("score", "alpha", "l1", "mult")])


@query("sel5_halving")
def sel5(spark, sf):
    """Folds one after the other, the better half of the trials goes on."""
    data, candidates, sampled = _prepared(spark, sf)
    report = search_elastic_net(data, candidates, sampled, halving=True)
    return report.groupBy("fold").agg(F.count("*").alias("n_trials"), rounded(F.min("mae")).alias("best_mae"))


@query("sel4_fusion_search")
def sel4(spark, sf):
    trials = trained(spark, sf).load("stage3_trials")
    return trials.groupBy("trial").agg(F.count("*").alias("n_folds"), rounded(F.avg("mae")).alias("score"))


@query("oof1_stage1")
def oof1(spark, sf):
    return trained(spark, sf).load("stage1_oof").withColumn("pred_age", rounded("pred_age", 5))


@query("oof2_stage2")
def oof2(spark, sf):
    df = trained(spark, sf).load("stage2_oof")
    return df.select("sample_id", *[rounded(c, 5).alias(c) for c in expert_columns(df.columns)])


@query("trn1_final_refit")
def trn1(spark, sf):
    return trained(spark, sf).load("stage1_intercepts").withColumn("intercept", rounded("intercept"))


@query("trn2_stage1_training", f"""WITH {t.SAMPLES_SQL}
SELECT sample_id, "Age" AS age, project_id, "Tissue", "Sex", "Is_Healthy" FROM samples WHERE "Is_Healthy\"""")
def trn2(spark, sf):
    """The out-of-fold table holds every healthy sample once (its predictions are in ``oof1_stage1``)."""
    oof = trained(spark, sf).load("stage1_oof").filter("pred_age is not null")
    return oof.select("sample_id", "age", "project_id", "Tissue", "Sex", "Is_Healthy")


@query("trn3_stage2_training", f"""WITH {t.SAMPLES_SQL}
SELECT sample_id, project_id, 3 AS n_experts FROM samples WHERE "Is_Healthy\"""")
def trn3(spark, sf):
    """Every healthy sample has a prediction of every expert."""
    df = trained(spark, sf).load("stage2_oof")
    filled = sum((F.col(c).isNotNull().cast("int") for c in expert_columns(df.columns)), F.lit(0))
    return df.select("sample_id", "project_id", filled.alias("n_experts"))


@query("trn4_stage3_training")
def trn4(spark, sf):
    df = trained(spark, sf).load("stage3_oof")
    cols = ["fused_age", "pred_age_stage1", "stage3_correction", "oof_correction"]
    return df.select("sample_id", "age", "Tissue", "fold", *[rounded(c, 5).alias(c) for c in cols])


@query("prd1_stage1_scoring")
def prd1(spark, sf):
    out = stages.predict_stage1(trained(spark, sf), t.samples(spark, sf), t.packed(spark, sf))
    return out.withColumn("pred_age_stage1", rounded("pred_age_stage1", 5))


@query("prd2_stage2_scoring")
def prd2(spark, sf):
    out = stages.predict_stage2(trained(spark, sf), t.packed(spark, sf))
    return out.select("sample_id", *[rounded(c, 5).alias(c) for c in expert_columns(out.columns)])


def _scored(spark, sf):
    return stages.predict_all(trained(spark, sf), t.samples(spark, sf), t.packed(spark, sf), _context(spark, sf))


@query("prd3_stage3_scoring")
def prd3(spark, sf):
    """Score the stage tables again, with a tissue the models have not seen for every seventh sample."""
    store = trained(spark, sf)
    stage2 = store.load("stage2_oof")
    unseen = F.when(F.col("sample_id").cast("long") % 7 == 0, F.lit("Tnew")).otherwise(F.col("Tissue"))
    joined = align.join_context(stage2.withColumn("Tissue", unseen), _context(spark, sf), training=False)
    out = stages.predict_stage3(store, joined)
    return out.select("sample_id", "Tissue", *[rounded(c, 5).alias(c) for c in ("fused_age", "pred_residual_stage3")])


@query("prd4_score_all")
def prd4(spark, sf):
    out = _scored(spark, sf)
    numbers = [c for c in out.columns if c.startswith(("pred_", "fused"))]
    return out.select("sample_id", "Age", "Tissue", "project_id", *[rounded(c, 5).alias(c) for c in numbers])


@query("art3_stage1_store", f"""WITH {t.CELLS_SQL}
SELECT feature, dim AS idx, round(coalesce(median(value), 0), 6) + 0.0 AS fill FROM cells WHERE "Is_Healthy" GROUP BY 1, 2""")
def art3(spark, sf):
    """The stored feature list carries the training medians."""
    return trained(spark, sf).load("features").select("feature", "idx", rounded("fill").alias("fill"))


@query("art4_stage2_store")
def art4(spark, sf):
    return trained(spark, sf).load("stage2_intercepts").withColumn("intercept", rounded("intercept"))


@query("art5_stage3_store")
def art5(spark, sf):
    table = trained(spark, sf).load("stage3_coefficients")
    return table.select("model_key", "feature", rounded("weight").alias("weight"))


@query("art7_trial_report")
def art7(spark, sf):
    return trained(spark, sf).load("stage2_trials").select(
        "model_key", "trial", "fold", "target_n", *[rounded(c).alias(c) for c in ("alpha", "l1", "mult", "mae")])


@query("imp1_importance")
def imp1(spark, sf):
    """Importance = absolute standardised coefficient, ten strongest features per expert."""
    store = trained(spark, sf)
    rows, fills = _training(spark, sf)
    from ..operators.stats import moments
    m = moments(rows.filter("Is_Healthy"), [], t.DIMS, "y", fills)
    spread = m.select("idx", F.sqrt(F.greatest(F.col("sxx") / F.col("n") - (F.col("sx") / F.col("n")) ** 2, F.lit(0.0))).alias("sd"))
    table = store.load("stage2_coefficients").join(settle(spread), "idx")
    table = table.withColumn("weight", F.col("weight") * F.col("sd")).drop("sd")
    top = linear.top_coefficients(table, ["model_key"], 10)
    return top.select("model_key", "feature", "rn", rounded(F.abs("weight")).alias("importance"))


@query("imp1_stage_performance")
def imp1_stages(spark, sf):
    """Metrics per stage on the held-out predictions."""
    df = trained(spark, sf).load("stage3_oof")
    long = df.select("age", "pred_age_stage1", "oof_fused_age").unpivot(["age"], ["pred_age_stage1", "oof_fused_age"], "stage", "yhat")
    return regression_metrics(long, ["stage"], "age", "yhat")


@query("fn2_target_pair", f"""WITH {t.SAMPLES_SQL}
SELECT sample_id, "Age" AS age FROM samples""")
def fn2_pair(spark, sf):
    """The inverse undoes the transform."""
    back = AGE_TARGET.inverse(AGE_TARGET.forward(F.col("Age")))
    return t.samples(spark, sf).select("sample_id", rounded(back).alias("age"))
