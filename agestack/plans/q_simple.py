"""Queries: the search and the training jobs with one feature, where plain SQL can state the whole result.

Orders are the samples: segment = tissue, nation = project, total price = feature.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import age_to_scale
from ..operators import folds
from ..operators.linear import coefficient_table
from ..operators.search import sampled_fold_stats, search_elastic_net
from ..session import local_table, scratch_path, settle
from ..sources.store import ModelStore
from . import stages, standins as t
from .q_stats import CURVE, METRICS_SQL, MODE_SQL, PULL, RIDGE, SUMS, _hash_rank_sql
from .registry import query, rounded

CANDIDATES = [
    {"trial": 0, "alpha": 0.01, "l1": 0.5, "min_cap": 30, "max_cap": 500, "mult": 0.1},
    {"trial": 1, "alpha": 0.001, "l1": 0.9, "min_cap": 10, "max_cap": 200, "mult": 0.05},
    {"trial": 2, "alpha": 0.1, "l1": 0.3, "min_cap": 50, "max_cap": 1000, "mult": 0.5},
]
CANDIDATES_SQL = """cand AS (SELECT * FROM (VALUES (0, 0.01::DOUBLE, 0.5::DOUBLE, 30, 500, 0.1::DOUBLE),
  (1, 0.001::DOUBLE, 0.9::DOUBLE, 10, 200, 0.05::DOUBLE), (2, 0.1::DOUBLE, 0.3::DOUBLE, 50, 1000, 0.5::DOUBLE))
  v(trial, alpha, l1, min_cap, max_cap, mult))"""
ROWS_SQL = f"""{t.ORDERS_SQL}, m AS ({MODE_SQL.format('order_samples')})"""
ROUND_ROBIN_SQL = f"""folds AS (
  SELECT project_id, (row_number() OVER (PARTITION BY mode_tissue ORDER BY {_hash_rank_sql(42, 'project_id')}) - 1) % 5 AS fold FROM m)"""
SERPENTINE_SQL = f"""folds AS (
  SELECT project_id, CASE WHEN turn < 5 THEN turn ELSE 9 - turn END AS fold FROM (
    SELECT project_id, (row_number() OVER (PARTITION BY mode_tissue ORDER BY floor(log2(n_samples)) DESC,
      {_hash_rank_sql(42, 'project_id')}) - 1) % 10 AS turn FROM m))"""
ENET_W = f"(sign({PULL}) * greatest(abs({PULL}) - alpha * l1, 0) / ({CURVE} + alpha * (1 - l1)))"
INV = "CASE WHEN b + w * x < 0 THEN 21 * exp(b + w * x) - 1 ELSE (b + w * x) * 21 + 20 END"
SEARCH_SQL = f"""rows AS (
  SELECT s.sample_id, s."Tissue", s.project_id, f.fold, CAST((o_orderkey * 37) % 90 AS DOUBLE) AS "Age", o_totalprice / 100000 AS x
  FROM order_samples s JOIN folds f USING (project_id)), targeted AS (SELECT *, {t.Y_SQL} AS target FROM rows), copies AS (
  SELECT r.*, h.held_out FROM targeted r JOIN range(6) h(held_out) ON h.held_out <> r.fold), kept AS (
  SELECT c.* FROM copies c SEMI JOIN (
    SELECT held_out, "Tissue" FROM copies GROUP BY ALL HAVING count(DISTINCT project_id) >= 2) v
    ON v.held_out = c.held_out AND v."Tissue" = c."Tissue"), med AS (
  SELECT held_out, median(n) AS m FROM (SELECT held_out, "Tissue", count(*) AS n FROM kept GROUP BY ALL) GROUP BY held_out), sizes AS (
  SELECT cand.*, held_out, CAST(trunc(least(greatest(med.m * mult, min_cap), max_cap)) AS INTEGER) AS target_n FROM cand, med), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY held_out, "Tissue"
    ORDER BY md5(sample_id || '|' || (42 + held_out % 5 * CAST(held_out < 5 AS INTEGER))), sample_id) AS rn FROM kept), s AS (
  SELECT trial, alpha, l1, target_n, z.held_out, {SUMS} FROM ranked r JOIN sizes z ON z.held_out = r.held_out AND r.rn <= z.target_n
  GROUP BY ALL), models AS (
  SELECT trial, held_out, target_n, {ENET_W} AS w, (sy - {ENET_W} * sx) / n AS b FROM s)"""


def _samples(spark, sf):
    df = t.order_samples(spark, sf)
    return df.select(
        "sample_id", "project_id", "Tissue", ((F.col("o_orderkey") * 37) % 90).cast("double").alias("Age"),
        F.lit("F").alias("Sex"), F.lit(True).alias("Is_Healthy"), F.array(F.col("o_totalprice") / 100000).alias("values"),
    )


@query("sel1_simple_objective", f"""WITH {ROWS_SQL}, {ROUND_ROBIN_SQL}, {CANDIDATES_SQL}, {SEARCH_SQL}
SELECT trial, CAST(fold AS INTEGER) AS fold, target_n, round(avg(abs("Age" - {INV})), 5) + 0.0 AS mae
FROM targeted JOIN models ON held_out = fold GROUP BY ALL""")
def sel1_simple(spark, sf):
    """Balanced sample, fit and held-out error of three candidates in five folds."""
    samples = _samples(spark, sf)
    data = settle(folds.with_folds(samples, folds.round_robin_folds(samples, 5, 42)).withColumn("y", age_to_scale(F.col("Age"))))
    caps = local_table(spark, [(c["trial"], c["min_cap"], c["max_cap"], c["mult"]) for c in CANDIDATES],
                       "trial int, min_cap int, max_cap int, mult double")
    report = search_elastic_net(data, CANDIDATES, sampled_fold_stats(data, 1, "y", caps))
    return report.select("trial", "fold", "target_n", rounded("mae", 5).alias("mae"))


FEATURE = "cg00000001_beta"
_stores: dict[tuple, ModelStore] = {}


def trained(spark, sf) -> ModelStore:
    """Stages 1 and 2 on the order samples with the three candidates."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _stores:
        store = ModelStore(spark, scratch_path(spark, "simple"))
        samples = settle(_samples(spark, sf))
        sites = local_table(spark, [("H1", 0, "cg00000001")], "hallmark string, pos int, site string")
        stages.train_stage1(store, samples.drop("values"), samples.select("sample_id", "values"), [FEATURE], sites, CANDIDATES)
        stages.train_stage2(store, CANDIDATES)
        _stores[key] = store
    return _stores[key]


BEST_SQL = f"""{ROWS_SQL}, {SERPENTINE_SQL}, {CANDIDATES_SQL}, {SEARCH_SQL}, report AS (
  SELECT trial, fold, avg(abs("Age" - {INV})) AS mae FROM targeted JOIN models ON held_out = fold GROUP BY ALL), best AS (
  SELECT trial FROM report GROUP BY trial ORDER BY avg(mae), trial LIMIT 1)"""


@query("sel3_simple_trials", f"""WITH {BEST_SQL}
SELECT trial, CAST(fold AS INTEGER) AS fold, round(mae, 5) + 0.0 AS mae FROM report""")
def sel3_simple(spark, sf):
    return trained(spark, sf).load("stage1_trials").select("trial", "fold", rounded("mae", 5).alias("mae"))


@query("trn1_simple_refit", f"""WITH {BEST_SQL}
SELECT 'Global' AS model_key, round(w, 5) + 0.0 AS weight, round(b, 5) + 0.0 AS intercept
FROM models SEMI JOIN best USING (trial) WHERE held_out = 5""")
def trn1_simple(spark, sf):
    """The best candidate refitted on the balanced sample of all samples."""
    models = trained(spark, sf).load_models("stage1")
    weight = coefficient_table(models, [FEATURE], ["model_key"]).select("model_key", rounded("weight", 5).alias("weight"))
    return weight.join(models.select("model_key", rounded("intercept", 5).alias("intercept")), "model_key")


@query("trn2_simple_oof", f"""WITH {BEST_SQL}
SELECT sample_id, "Age" AS age, project_id, "Tissue", round({INV}, 5) + 0.0 AS pred_age
FROM targeted JOIN models ON held_out = fold SEMI JOIN best USING (trial)""")
def trn2_simple(spark, sf):
    """The whole stage-1 job: folds, samples, search, held-out predictions."""
    oof = trained(spark, sf).load("stage1_oof")
    return oof.select("sample_id", "age", "project_id", "Tissue", rounded("pred_age", 5).alias("pred_age"))


@query("trn3_simple_oof", f"""WITH {BEST_SQL}
SELECT sample_id, round({INV}, 5) + 0.0 AS "pred_resid_H1"
FROM targeted JOIN models ON held_out = fold SEMI JOIN best USING (trial)""")
def trn3_simple(spark, sf):
    return trained(spark, sf).load("stage2_oof").select("sample_id", rounded("pred_resid_H1", 5).alias("pred_resid_H1"))


@query("oof2_simple", f"""WITH {BEST_SQL}
SELECT sample_id, "Age" AS age, project_id, "Tissue", round({INV}, 5) + 0.0 AS pred_age, round({INV}, 5) + 0.0 AS "pred_resid_H1"
FROM targeted JOIN models ON held_out = fold SEMI JOIN best USING (trial)""")
def oof2_simple(spark, sf):
    """The stage-2 table: the expert sees the same feature as the global model here, so both predict alike."""
    df = trained(spark, sf).load("stage2_oof")
    return df.select("sample_id", "age", "project_id", "Tissue", *[rounded(c, 5).alias(c) for c in ("pred_age", "pred_resid_H1")])


@query("fit4_simple_expert", f"""WITH {BEST_SQL}
SELECT 'H1' AS model_key, '{FEATURE}' AS feature, 0 AS idx, round(w, 5) + 0.0 AS weight
FROM models SEMI JOIN best USING (trial) WHERE held_out = 5""")
def fit4_simple(spark, sf):
    """The expert of the one hallmark, as stored."""
    return trained(spark, sf).load("stage2_coefficients").select("model_key", "feature", "idx", rounded("weight", 5).alias("weight"))


@query("art4_simple_store", f"""WITH {BEST_SQL}
SELECT 'H1' AS model_key, round(b, 5) + 0.0 AS intercept, 'age' AS target, 'H1' AS hallmarks
FROM models SEMI JOIN best USING (trial) WHERE held_out = 5""")
def art4_simple(spark, sf):
    """Intercepts and settings of stage 2 as stored."""
    store = trained(spark, sf)
    settings = store.load_settings("stage2_settings")
    return store.load("stage2_intercepts").select(
        "model_key", rounded("intercept", 5).alias("intercept"), F.lit(settings["target"]).alias("target"),
        F.lit(",".join(settings["hallmarks"])).alias("hallmarks"))


@query("art7_simple_report", f"""WITH {BEST_SQL}
SELECT 'H1' AS model_key, trial, CAST(fold AS INTEGER) AS fold, target_n, alpha, l1, min_cap, max_cap, mult, round(mae, 5) + 0.0 AS mae
FROM report JOIN cand USING (trial) JOIN (SELECT trial, held_out AS fold, target_n FROM models) USING (trial, fold)""")
def art7_simple(spark, sf):
    return trained(spark, sf).load("stage2_trials").withColumn("mae", rounded("mae", 5))


ERRORS_SQL = f"""{BEST_SQL}, errors AS (
  SELECT trial, CAST(fold AS INTEGER) AS fold, project_id, "Tissue", abs("Age" - {INV}) AS e FROM targeted JOIN models ON held_out = fold), cube AS (
  SELECT trial, CASE WHEN grouping(fold) = 0 THEN 'fold' WHEN grouping(project_id) = 0 THEN 'project_id'
                     WHEN grouping("Tissue") = 0 THEN 'Tissue' ELSE 'all' END AS level, fold, project_id, "Tissue", avg(e) AS mae, count(*) AS n
  FROM errors GROUP BY GROUPING SETS ((trial), (trial, fold), (trial, project_id), (trial, "Tissue")))"""


@query("agg9_error_cube", f"""WITH {ERRORS_SQL}
SELECT 'Global' AS model_key, trial, level, fold, project_id, "Tissue", round(mae, 5) + 0.0 AS mae, n FROM cube""")
def agg9_cube(spark, sf):
    """Held-out errors of every trial by fold, project and tissue, as the stage-1 job stores them."""
    return trained(spark, sf).load("stage1_errors").withColumn("mae", rounded("mae", 5))


@query("agg9_trial_report", f"""WITH {ERRORS_SQL}, worst AS (
  SELECT trial, "Tissue", mae FROM cube WHERE level = 'Tissue' QUALIFY row_number() OVER (PARTITION BY trial ORDER BY mae DESC, "Tissue") = 1)
SELECT 'Global' AS model_key, c.trial, alpha, l1, min_cap, max_cap, mult, round(max(c.mae) FILTER (level = 'all'), 5) + 0.0 AS micro_mae,
       round(avg(c.mae) FILTER (level = 'project_id'), 5) + 0.0 AS macro_mae, round(avg(c.mae) FILTER (level = 'Tissue'), 5) + 0.0 AS tissue_mae,
       round(avg(c.mae) FILTER (level = 'fold'), 5) + 0.0 AS fold_mae, max(n) FILTER (level = 'all') AS n,
       count(*) FILTER (level = 'fold') AS n_folds, count(*) FILTER (level = 'project_id') AS n_projects,
       count(*) FILTER (level = 'Tissue') AS n_tissues, w."Tissue" AS worst_tissue, round(w.mae, 5) + 0.0 AS worst_mae
FROM cube c JOIN worst w USING (trial) JOIN cand USING (trial) GROUP BY ALL""")
def agg9_report(spark, sf):
    """One line per trial: over all rows, over projects, over tissues and over folds."""
    errors = ("micro_mae", "macro_mae", "tissue_mae", "fold_mae", "worst_mae")
    return trained(spark, sf).load("stage1_report").withColumns({c: rounded(c, 5) for c in errors})


PERFORMANCE_SQL = f"""{BEST_SQL}, held AS (
  SELECT project_id, "Age" AS y, {INV} AS yhat FROM targeted JOIN models ON held_out = fold SEMI JOIN best USING (trial)), macro AS (
  SELECT round(avg(mae), 4) + 0.0 AS "MacroMAE", count(*) AS n_projects FROM (SELECT avg(abs(y - yhat)) AS mae FROM held GROUP BY project_id)), scored AS (
  SELECT k AS model_key, y, yhat FROM held, (VALUES ('Global'), ('H1')) v(k))"""


@query("imp1_job_performance", f"""WITH {PERFORMANCE_SQL}, metrics AS ({METRICS_SQL.format(key="model_key,", group="GROUP BY model_key")})
SELECT * FROM metrics, macro""")
def imp1_performance(spark, sf):
    """Metrics of the global model and of the expert (which sees the same feature here), as the jobs store them."""
    store = trained(spark, sf)
    return store.load("stage1_performance").unionByName(store.load("stage2_performance"))


@query("imp1_job_importance", f"""WITH {BEST_SQL}
SELECT k AS model_key, 0 AS idx, '{FEATURE}' AS feature, round(w, 5) + 0.0 AS weight,
       round(abs(w) * (SELECT stddev_pop(x) FROM targeted), 5) + 0.0 AS importance, 1.0::DOUBLE AS share, 1::BIGINT AS rank
FROM models SEMI JOIN best USING (trial), (VALUES ('Global'), ('H1')) v(k) WHERE held_out = 5 AND w <> 0""")
def imp1_importance(spark, sf):
    store = trained(spark, sf)
    table = store.load("stage1_importance").unionByName(store.load("stage2_importance"))
    return table.withColumns({c: rounded(c, 5) for c in ("weight", "importance", "share")})


@query("sel5_simple_halving", f"""WITH {BEST_SQL}, second AS (
  SELECT trial FROM report WHERE fold = 0 ORDER BY mae, trial LIMIT 2), third AS (
  SELECT trial FROM report SEMI JOIN second USING (trial) WHERE fold <= 1 GROUP BY trial ORDER BY sum(mae), trial LIMIT 1)
SELECT trial, CAST(fold AS INTEGER) AS fold, round(mae, 5) + 0.0 AS mae FROM report
WHERE fold = 0 OR (fold = 1 AND trial IN (FROM second)) OR (fold > 1 AND trial IN (FROM third))""")
def sel5_simple(spark, sf):
    """Three candidates on the first fold, the better two on the second, the best of these on the others."""
    data = trained(spark, sf).load("training")
    caps = local_table(spark, [(c["trial"], c["min_cap"], c["max_cap"], c["mult"]) for c in CANDIDATES],
                       "trial int, min_cap int, max_cap int, mult double")
    report = search_elastic_net(data, CANDIDATES, sampled_fold_stats(data, 1, "y", caps), halving=True)
    return report.select("trial", "fold", rounded("mae", 5).alias("mae"))


ALL_SQL = f"""{BEST_SQL}, chosen AS (SELECT held_out, w, b FROM models SEMI JOIN best USING (trial)), oof AS (
  SELECT t."Tissue", "Age" - {INV} AS target, {INV} AS x FROM targeted t JOIN chosen ON held_out = fold), s3 AS (
  SELECT "Tissue" AS model_key, {SUMS} FROM oof GROUP BY ALL HAVING count(*) >= 50
  UNION ALL SELECT 'Global', {SUMS} FROM oof), fusion AS (
  SELECT model_key, {RIDGE} AS w3, (sy - {RIDGE} * sx) / n AS b3 FROM s3), first AS (
  SELECT sample_id, "Age", "Tissue", project_id, {INV} AS p FROM targeted JOIN chosen ON held_out = 5)"""


@query("prd4_simple_all", f"""WITH {ALL_SQL}
SELECT sample_id, "Age", f."Tissue", f.project_id, round(p, 4) + 0.0 AS pred_age_stage1, round(p, 4) + 0.0 AS "pred_resid_H1",
       round(coalesce(a.b3 + a.w3 * p, g.b3 + g.w3 * p), 4) + 0.0 AS pred_residual_stage3,
       round(p + coalesce(a.b3 + a.w3 * p, g.b3 + g.w3 * p), 4) + 0.0 AS fused_age
FROM first f LEFT JOIN fusion a ON a.model_key = f."Tissue" JOIN fusion g ON g.model_key = 'Global'""")
def prd4_simple(spark, sf):
    """All three stored stages on the samples, end to end."""
    store = trained(spark, sf)
    stages.train_stage3(store, store.load("stage1_oof"), store.load("stage2_oof"), None)
    samples = settle(_samples(spark, sf))
    out = stages.predict_all(store, samples.drop("values"), samples.select("sample_id", "values"), None)
    numbers = ["pred_age_stage1", "pred_resid_H1", "pred_residual_stage3", "fused_age"]
    return out.select("sample_id", "Age", "Tissue", "project_id", *[rounded(c, 4).alias(c) for c in numbers])


# Stage 3 on the parts: brand = tissue, project = type and name, one expert (the retail price in hundreds).
FUSION_SQL = f"""rows AS (
  SELECT CAST(p_partkey AS VARCHAR) AS sample_id, p_brand AS "Tissue", p_type || '|' || p_name AS project_id,
         CAST(p_size AS DOUBLE) AS age, CAST(p_size + p_partkey % 7 - 3 AS DOUBLE) AS pred_age_stage1,
         CAST(3 - p_partkey % 7 AS DOUBLE) AS target, p_retailprice / 100 AS x FROM part), m AS ({MODE_SQL.format('rows')}),
  {SERPENTINE_SQL}, data AS (SELECT r.*, f.fold FROM rows r JOIN folds f USING (project_id)), sets AS (
  SELECT d.*, h.held_out FROM data d JOIN range(6) h(held_out) ON h.held_out <> d.fold), s AS (
  SELECT held_out, "Tissue" AS model_key, {SUMS} FROM sets GROUP BY ALL HAVING count(*) >= 64
  UNION ALL SELECT held_out, 'Global', {SUMS} FROM sets GROUP BY ALL), family AS (
  SELECT held_out, model_key, {RIDGE} AS w, (sy - {RIDGE} * sx) / n AS b FROM s), corrected AS (
  SELECT d.*, coalesce(a.b + a.w * x, g.b + g.w * x) AS correction, coalesce(c.b + c.w * x, e.b + e.w * x) AS oof FROM data d
  LEFT JOIN family a ON a.held_out = 5 AND a.model_key = d."Tissue" JOIN family g ON g.held_out = 5 AND g.model_key = 'Global'
  LEFT JOIN family c ON c.held_out = d.fold AND c.model_key = d."Tissue" JOIN family e ON e.held_out = d.fold AND e.model_key = 'Global')"""
_fusion: dict[tuple, ModelStore] = {}


def fused(spark, sf) -> ModelStore:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _fusion:
        store = ModelStore(spark, scratch_path(spark, "fusion"))
        part = t.table(spark, sf, "part")
        ids = F.col("p_partkey").cast("string").alias("sample_id")
        first = part.select(ids, F.col("p_size").cast("double").alias("Age"), F.col("p_brand").alias("Tissue"),
                            F.concat_ws("|", "p_type", "p_name").alias("project_id"),
                            (F.col("p_size") + F.col("p_partkey") % 7 - 3).cast("double").alias("Stage1_Pred"))
        second = part.select(ids, (F.col("p_retailprice") / 100).alias("pred_resid_price"))
        stages.train_stage3(store, first, second, None, alpha=1.0, min_samples=64)
        _fusion[key] = store
    return _fusion[key]


@query("trn4_simple_fusion", f"""WITH {FUSION_SQL}
SELECT sample_id, age, "Tissue", round(pred_age_stage1 + correction, 5) + 0.0 AS fused_age,
       round(correction, 5) + 0.0 AS stage3_correction, round(oof, 5) + 0.0 AS oof_correction FROM corrected""")
def trn4_simple(spark, sf):
    """The whole stage-3 job: residual target, tissue family with fallback, in-sample and held-out corrections."""
    df = fused(spark, sf).load("stage3_oof")
    return df.select("sample_id", "age", "Tissue", *[rounded(c, 5).alias(c) for c in ("fused_age", "stage3_correction", "oof_correction")])


@query("art5_simple_models", f"""WITH {FUSION_SQL}
SELECT model_key, 'pred_resid_price' AS feature, round(w, 5) + 0.0 AS weight, round(b, 5) + 0.0 AS intercept FROM family WHERE held_out = 5""")
def art5_simple(spark, sf):
    store = fused(spark, sf)
    weights = store.load("stage3_coefficients").select("model_key", "feature", rounded("weight", 5).alias("weight"))
    return weights.join(store.load("stage3_intercepts").withColumn("intercept", rounded("intercept", 5)), "model_key")


@query("imp1_fusion_performance", f"""WITH {FUSION_SQL}, steps AS (
  SELECT k AS model_key, project_id, age AS y, pred_age_stage1 + CASE k WHEN 'stage3' THEN oof WHEN 'stage3_in_sample' THEN correction ELSE 0 END AS yhat
  FROM corrected, (VALUES ('stage1'), ('stage3'), ('stage3_in_sample')) v(k)), macro AS (
  SELECT model_key, round(avg(mae), 4) + 0.0 AS "MacroMAE", count(*) AS n_projects FROM (
    SELECT model_key, project_id, avg(abs(y - yhat)) AS mae FROM steps GROUP BY ALL) GROUP BY ALL), scored AS (
  SELECT model_key, y, yhat FROM steps), metrics AS ({METRICS_SQL.format(key="model_key,", group="GROUP BY model_key")})
SELECT * FROM metrics JOIN macro USING (model_key)""")
def imp1_fusion(spark, sf):
    """Metrics before and after the fusion, held out and in sample, as the stage-3 job stores them."""
    return fused(spark, sf).load("stage3_performance")


@query("imp1_fusion_importance", f"""WITH {FUSION_SQL}
SELECT model_key, 0 AS idx, 'pred_resid_price' AS feature, round(w, 5) + 0.0 AS weight,
       round(abs(w) * (SELECT stddev_pop(x) FROM data), 5) + 0.0 AS importance, 1.0::DOUBLE AS share, 1::BIGINT AS rank
FROM family WHERE held_out = 5 AND w <> 0""")
def imp1_fusion_weights(spark, sf):
    table = fused(spark, sf).load("stage3_importance")
    return table.withColumns({c: rounded(c, 5) for c in ("weight", "importance", "share")})


@query("prd3_stored_fusion", f"""WITH {FUSION_SQL}, fresh AS (
  SELECT *, CASE WHEN CAST(sample_id AS BIGINT) % 3 = 0 THEN 'Brand#new' ELSE "Tissue" END AS scored_as FROM data)
SELECT f.sample_id, f.scored_as AS "Tissue", round(coalesce(a.b + a.w * x, g.b + g.w * x), 5) + 0.0 AS pred_residual_stage3
FROM fresh f LEFT JOIN family a ON a.held_out = 5 AND a.model_key = f.scored_as
JOIN family g ON g.held_out = 5 AND g.model_key = 'Global'""")
def prd3_stored(spark, sf):
    """Stored models reloaded; every third sample has a tissue they have not seen."""
    part = t.table(spark, sf, "part")
    tissue = F.when(F.col("p_partkey") % 3 == 0, F.lit("Brand#new")).otherwise(F.col("p_brand"))
    df = part.select(F.col("p_partkey").cast("string").alias("sample_id"), tissue.alias("Tissue"),
                     F.col("p_size").cast("double").alias("pred_age"), (F.col("p_retailprice") / 100).alias("pred_resid_price"))
    out = stages.predict_stage3(fused(spark, sf), df)
    return out.select("sample_id", "Tissue", rounded("pred_residual_stage3", 5).alias("pred_residual_stage3"))
