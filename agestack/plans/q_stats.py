"""Queries: imputation, metrics, correlation, folds, sampling, simple fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.metrics import fold_scores, mae, micro_macro_mae, regression_metrics
from ..functions.scalar import AGE_TARGET, age_to_scale, scale_to_age
from ..operators import folds, linear, selection
from ..operators.align import pick_features
from ..operators.arrowhead import fit_arrowhead
from ..operators.impute import fill_values, filter_and_impute, fold_fills, impute_cells, impute_packed
from ..operators.linear import fit_elastic_net, fit_ridge, scale_table
from ..operators.ranking import exact_median, narrowing_median
from ..operators.score import score_simple_with_fallback
from ..operators.search import grid_candidates, random_candidates
from ..operators.stats import all_but_each_fold, gram, simple_stats
from ..session import scratch_path, settle
from ..sources.store import ModelStore
from . import standins as t
from .registry import query, rounded


@query("agg1_median_impute", f"""WITH {t.FILLED_SQL}
SELECT sample_id, feature, round(value, 6) + 0.0 AS value FROM filled""")
def agg1(spark, sf):
    cells = t.cells(spark, sf)
    return impute_cells(cells, fill_values(cells)).select("sample_id", "feature", rounded("value").alias("value"))


@query("agg1_narrowing_median", f"""WITH {t.CELLS_SQL}
SELECT feature, round(median(value), 6) + 0.0 AS median FROM cells WHERE value IS NOT NULL GROUP BY feature""")
def agg1_narrow(spark, sf):
    """The median route for groups too large for one task."""
    return narrowing_median(t.cells(spark, sf), ["feature"], "value", group_rows=50).withColumn("median", rounded("median"))


@query("agg1_impute_packed", f"""WITH {t.FILLED_SQL}
SELECT sample_id, round(sum(value * (dim + 1)), 5) + 0.0 AS weighted FROM filled GROUP BY sample_id""")
def agg1_packed(spark, sf):
    """The same fill on packed rows; one weighted sum per row stands for the array."""
    filled = impute_packed(t.packed(spark, sf), t.fills(spark, sf))
    terms = F.transform("values", lambda x, i: x * (i + 1))
    total = F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)
    return filled.select("sample_id", rounded(total, 5).alias("weighted"))


EVENTS_SQL = """wide AS (
  SELECT user_id, CAST(ts AS DATE) AS day, avg(value) FILTER (event_type = 'click') AS click,
         avg(value) FILTER (event_type = 'error') AS error, avg(value) FILTER (event_type = 'purchase') AS purchase,
         avg(value) FILTER (event_type = 'view') AS view
  FROM events GROUP BY 1, 2)"""


def _event_matrix(spark, sf):
    events = t.table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    wide = events.groupBy("user_id", "day").pivot("event_type", ["click", "error", "purchase", "view"]).agg(F.avg("value"))
    return wide.withColumn("sample_id", F.concat_ws("|", "user_id", "day")).drop("user_id", "day")


def _impute_sql(fn: str) -> str:
    cols = ", ".join(f'round(coalesce({c}, (SELECT {fn.format(c=c)} FROM wide), 0), 6) + 0.0 AS {c}'
                     for c in ("click", "error", "purchase", "view"))
    return f"WITH {EVENTS_SQL} SELECT user_id || '|' || day AS sample_id, {cols} FROM wide"


def _imputed(spark, sf, strategy):
    df = filter_and_impute(settle(_event_matrix(spark, sf)), strategy)
    return df.select("sample_id", *[rounded(c).alias(c) for c in ("click", "error", "purchase", "view")])


@query("agg2_impute_median", _impute_sql("median({c})"))
def agg2_median(spark, sf):
    return _imputed(spark, sf, "median")


@query("agg2_impute_mean", _impute_sql("avg({c})"))
def agg2_mean(spark, sf):
    return _imputed(spark, sf, "mean")


@query("agg2_impute_zero", _impute_sql("min(0)"))
def agg2_zero(spark, sf):
    return _imputed(spark, sf, "zero")


@query("agg3_projects_per_tissue", f"""WITH {t.ORDERS_SQL}
SELECT "Tissue", count(DISTINCT project_id) AS n_projects FROM order_samples GROUP BY 1""")
def agg3(spark, sf):
    return folds.projects_per_tissue(t.order_samples(spark, sf))


@query("agg4_target_size", f"""WITH {t.SAMPLES_SQL}, counts AS (SELECT count(*) AS n FROM samples GROUP BY "Tissue")
SELECT CAST(trunc(least(greatest(median(n) * 1.25, 30), 500)) AS INTEGER) AS target_n, count(*) AS n_tissues FROM counts""")
def agg4(spark, sf):
    return folds.target_sizes(t.samples(spark, sf), 30, 500, 1.25)


MODE_SQL = """SELECT project_id, mode_tissue, n_samples FROM (
  SELECT project_id, "Tissue" AS mode_tissue, CAST(sum(n) OVER (PARTITION BY project_id) AS BIGINT) AS n_samples,
         row_number() OVER (PARTITION BY project_id ORDER BY n DESC, "Tissue") AS rn
  FROM (SELECT project_id, "Tissue", count(*) AS n FROM {} GROUP BY 1, 2)) WHERE rn = 1"""


@query("agg5_mode_tissue", f"WITH {t.SAMPLES_SQL} {MODE_SQL.format('samples')}")
def agg5(spark, sf):
    return folds.mode_tissue(t.samples(spark, sf))


METRICS_SQL = """SELECT {key} count(*) AS n, round(avg(abs(y - yhat)), 4) AS "MAE",
  round(CASE WHEN var_pop(y) > 0 THEN 1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*))
             WHEN sum((y - yhat) * (y - yhat)) = 0 THEN 1 ELSE 0 END, 4) AS "R2",
  round(CASE WHEN count(*) > 1 AND stddev_pop(y) > 1e-9 AND stddev_pop(yhat) > 1e-9
             THEN covar_pop(y, yhat) / (stddev_pop(y) * stddev_pop(yhat)) ELSE 0 END, 4) AS "PearsonR",
  round(median(abs(y - yhat)), 4) AS "MedianAE" FROM scored {group}"""


@query("agg6_metrics", f"""WITH {t.PARTS_SQL}, scored AS (
  SELECT p_brand, y, CASE WHEN p_brand = 'Brand#7' THEN 25 ELSE yhat END AS yhat FROM parts)
{METRICS_SQL.format(key="p_brand,", group="GROUP BY p_brand")}""")
def agg6(spark, sf):
    """Per brand; one brand has a constant prediction."""
    flat = F.when(F.col("p_brand") == "Brand#7", F.lit(25.0)).otherwise(F.col("yhat"))
    return regression_metrics(t.parts(spark, sf).withColumn("yhat", flat), ["p_brand"])


LINES_SQL = "scored AS (SELECT l_quantity AS y, l_extendedprice / 2000 AS yhat, l_returnflag FROM lineitem)"


@query("agg6_metrics_overall", f"WITH {LINES_SQL} {METRICS_SQL.format(key='', group='')}")
def agg6_all(spark, sf):
    lines = t.table(spark, sf, "lineitem").select(F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 2000).alias("yhat"))
    return regression_metrics(lines, [])


@query("agg7_score", f"WITH {LINES_SQL} SELECT l_returnflag, round(avg(abs(y - yhat)), 6) + 0.0 AS score FROM scored GROUP BY 1")
def agg7(spark, sf):
    lines = t.table(spark, sf, "lineitem")
    score = mae(F.col("l_quantity"), F.col("l_extendedprice") / 2000)
    return lines.groupBy("l_returnflag").agg(rounded(score).alias("score"))


@query("agg8_fold_mean", f"""WITH {t.PARTS_SQL}, f AS (
  SELECT p_brand, p_partkey % 5 AS fold, avg(abs(y - yhat)) AS mae FROM parts GROUP BY 1, 2)
SELECT p_brand, round(avg(mae), 6) + 0.0 AS score, count(*) AS n_folds FROM f GROUP BY 1""")
def agg8(spark, sf):
    scored = fold_scores(t.parts(spark, sf).withColumn("fold", F.col("p_partkey") % 5), ["p_brand"])
    return scored.withColumn("score", rounded("score"))


@query("agg9_micro_macro", f"""WITH {t.PARTS_SQL}, g AS (
  SELECT project_id, avg(abs(y - yhat)) AS mae FROM parts GROUP BY 1)
SELECT (SELECT round(avg(abs(y - yhat)), 6) + 0.0 FROM parts) AS micro_mae, round(avg(mae), 6) + 0.0 AS macro_mae,
       count(*) AS n_groups FROM g""")
def agg9(spark, sf):
    out = micro_macro_mae(t.parts(spark, sf))
    return out.withColumns({c: rounded(c) for c in ("micro_mae", "macro_mae")})


CORR_SQL = f"""{t.FILLED_SQL}, corr AS (
  SELECT feature, count(*) AS n, CASE WHEN count(*) < 2 THEN 0 ELSE
    covar_pop(value, y) * count(*) / (sqrt(var_pop(value) * count(*) * var_pop(y) * count(*)) + 1e-12) END AS r
  FROM (SELECT feature, value, {t.Y_SQL} AS y FROM filled) GROUP BY feature)"""


def _correlations(spark, sf):
    rows = t.packed(spark, sf, with_meta=True).withColumn("y", age_to_scale(F.col("Age")))
    fills = t.fills(spark, sf)
    r = selection.packed_correlation(rows, t.DIMS, "y", fills)
    return r.withColumn("feature", F.get(F.lit(t.FEATURES), F.col("idx"))).select("feature", "n", "r")


@query("agg10_correlation", f"WITH {CORR_SQL} SELECT feature, n, round(r, 6) + 0.0 AS r FROM corr")
def agg10(spark, sf):
    return _correlations(spark, sf).withColumn("r", rounded("r"))


@query("agg10_cell_correlation", f"""WITH {t.CELLS_SQL}
SELECT feature, count(*) AS n, round(covar_pop(value, "Age") * count(*)
  / (sqrt(var_pop(value) * count(*) * var_pop("Age") * count(*)) + 1e-12), 6) + 0.0 AS r
FROM cells WHERE value IS NOT NULL GROUP BY feature""")
def agg10_cells(spark, sf):
    """On long cells, gaps left out."""
    return selection.cell_correlation(t.cells(spark, sf, with_meta=True), "Age").withColumn("r", rounded("r"))


@query("agg11_anchor_ids", "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS sample_id FROM orders")
def agg11(spark, sf):
    from ..operators.align import anchor_ids
    return anchor_ids(t.table(spark, sf, "orders").select(F.col("o_custkey").alias("sample_id")))


SELECT_SQL = f"""{CORR_SQL}, {t.HALLMARKS_SQL}, ranked AS (
  SELECT h.hallmark, h.feature, round(abs(r), 9) AS abs_r,
         row_number() OVER (PARTITION BY hallmark ORDER BY round(abs(r), 9) DESC, pos) - 1 AS rank
  FROM hallmark_features h JOIN corr USING (feature)), won AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY rank, hallmark) AS w FROM ranked) WHERE w = 1)"""


@query("win1_rank_in_hallmark", f"WITH {SELECT_SQL} SELECT hallmark, feature, rank, round(abs_r, 6) + 0.0 AS abs_r FROM ranked")
def win1(spark, sf):
    ranked = selection.rank_in_hallmark(t.hallmark_features(spark), _correlations(spark, sf))
    return ranked.select("hallmark", "feature", "rank", rounded("abs_r").alias("abs_r"))


@query("win2_winner_takes_all", f"WITH {SELECT_SQL} SELECT feature, hallmark FROM won")
def win2(spark, sf):
    ranked = selection.rank_in_hallmark(t.hallmark_features(spark), _correlations(spark, sf))
    return selection.winners(ranked).select("feature", "hallmark")


@query("sel6_select_features", f"WITH {SELECT_SQL} SELECT feature, hallmark, rank, round(abs_r, 6) + 0.0 AS abs_r FROM won")
def sel6(spark, sf):
    """Flagship: impute, correlate, rank within hallmarks, winner takes all."""
    won = selection.assign_features(t.hallmark_features(spark), _correlations(spark, sf))
    return won.select("feature", "hallmark", "rank", rounded("abs_r").alias("abs_r"))


@query("agg12_features_by_hallmark", f"""WITH {SELECT_SQL}
SELECT hallmark, string_agg(feature, ',' ORDER BY feature) AS features FROM won GROUP BY hallmark""")
def agg12(spark, sf):
    won = selection.assign_features(t.hallmark_features(spark), _correlations(spark, sf))
    return selection.features_by_hallmark(won).withColumn("features", F.array_join("features", ","))


def _hash_rank_sql(seed: int, key: str = "sample_id") -> str:
    return f"md5({key} || '|{seed}'), {key}"


@query("win3_balanced_sample", f"""WITH {t.ORDERS_SQL}, valid AS (
  SELECT "Tissue" FROM order_samples GROUP BY 1 HAVING count(DISTINCT project_id) >= 2), kept AS (
  SELECT * FROM order_samples WHERE "Tissue" IN (SELECT "Tissue" FROM valid)), target AS (
  SELECT trunc(least(greatest(median(n) * 0.1, 30), 500)) AS n FROM (SELECT count(*) AS n FROM kept GROUP BY "Tissue"))
SELECT sample_id, "Tissue", rn FROM (
  SELECT sample_id, "Tissue", row_number() OVER (PARTITION BY "Tissue" ORDER BY {_hash_rank_sql(42)}) AS rn FROM kept)
WHERE rn <= (SELECT n FROM target)""")
def win3(spark, sf):
    """A sampling operator: its limit is the feature."""
    sampled, _ = folds.balanced_sample(t.order_samples(spark, sf), 2, 30, 500, 0.1, 42)
    return sampled.select("sample_id", "Tissue", "rn")


FOLDS_SQL = f"""m AS ({MODE_SQL.format('samples')}), folds AS (
  SELECT project_id, mode_tissue, CAST((row_number() OVER (PARTITION BY mode_tissue
    ORDER BY {_hash_rank_sql(42, 'project_id')}) - 1) % 5 AS INTEGER) AS fold FROM m)"""


@query("win4_round_robin_folds", f"""WITH {t.SAMPLES_SQL}, {FOLDS_SQL}
SELECT s.sample_id, s.project_id, f.fold FROM samples s JOIN folds f USING (project_id)""")
def win4(spark, sf):
    samples = t.samples(spark, sf)
    return folds.with_folds(samples, folds.round_robin_folds(samples, 5, 42)).select("sample_id", "project_id", "fold")


SERPENTINE_SQL = f"""m AS ({MODE_SQL.format('samples')}), dealt AS (
  SELECT *, (row_number() OVER (PARTITION BY mode_tissue ORDER BY floor(log2(n_samples)) DESC,
    {_hash_rank_sql(42, 'project_id')}) - 1) % 10 AS turn FROM m), folds AS (
  SELECT project_id, CAST(CASE WHEN turn < 5 THEN turn ELSE 9 - turn END AS INTEGER) AS fold FROM dealt)"""


@query("win5_balanced_folds", f"""WITH {t.SAMPLES_SQL}, {SERPENTINE_SQL}
SELECT s.sample_id, f.fold FROM samples s JOIN folds f USING (project_id)""")
def win5(spark, sf):
    samples = t.samples(spark, sf)
    return folds.with_folds(samples, folds.balanced_folds(samples, 5, 42)).select("sample_id", "fold")


# Step k deals project (k - 1) % m + 1: three turns over all of them.  The pull of a fold is the sum of inner products with its projects.
STRATIFIED_SQL = f"""cnt AS (SELECT project_id, "Tissue", count(*) AS n FROM samples GROUP BY ALL), shares AS (
  SELECT project_id, "Tissue", n, n / sum(n) OVER (PARTITION BY "Tissue") AS share FROM cnt), ordered AS (
  SELECT project_id, sum(n) AS n, row_number() OVER (ORDER BY round(sum(share * share), 12) DESC, md5('=' || project_id || '|42')) AS i
  FROM shares GROUP BY project_id), pairs AS (
  SELECT a.project_id AS a, b.project_id AS b, sum(a.share * b.share) AS g FROM shares a JOIN shares b USING ("Tissue") GROUP BY ALL), lines AS (
  SELECT x.i, list(CASE WHEN x.i = y.i THEN 0 ELSE coalesce(g, 0) END ORDER BY y.i) AS g, list(CASE WHEN x.i = y.i THEN 0 ELSE y.n END ORDER BY y.i) AS n,
         count(*) AS m FROM ordered x JOIN ordered y ON true LEFT JOIN pairs ON a = x.project_id AND b = y.project_id GROUP BY x.i), walk AS (
  SELECT 0 AS k, list_transform(range(m), lambda j: -1) AS f, m FROM lines WHERE i = 1
  UNION ALL
  SELECT k + 1, list_transform(f, lambda v, j: CASE WHEN j = l.i THEN list_sort(list_transform(range(5), lambda c: {{
      'pull': round(list_sum(list_transform(l.g, lambda x, y: CASE WHEN f[y] = c THEN x ELSE 0 END)), 12),
      'rows': list_sum(list_transform(l.n, lambda x, y: CASE WHEN f[y] = c THEN x ELSE 0 END)), 'c': c}}))[1].c ELSE v END), w.m
  FROM walk w JOIN lines l ON l.i = w.k % w.m + 1 WHERE k < 3 * w.m), folds AS (
  SELECT project_id, CAST(f[i] AS INTEGER) AS fold, n FROM ordered, (SELECT f FROM walk ORDER BY k DESC LIMIT 1))"""


@query("win5_stratified_folds", f"""WITH RECURSIVE {t.SAMPLES_SQL}, {STRATIFIED_SQL}
SELECT s.sample_id, f.fold FROM samples s JOIN folds f USING (project_id)""")
def win5_stratified(spark, sf):
    samples = t.samples(spark, sf)
    return folds.with_folds(samples, folds.stratified_folds(samples, 5, 42)).select("sample_id", "fold")


@query("win5_fold_shares", f"""WITH RECURSIVE {t.SAMPLES_SQL}, {STRATIFIED_SQL}
SELECT "Tissue", CAST(c AS INTEGER) AS fold, count(*) FILTER (fold = c) AS n, round(count(*) FILTER (fold = c) / count(*), 6) + 0.0 AS share
FROM samples JOIN folds USING (project_id), range(5) r(c) GROUP BY "Tissue", c""")
def win5_shares(spark, sf):
    samples = t.samples(spark, sf)
    folded = folds.with_folds(samples, folds.stratified_folds(samples, 5, 42))
    return folds.fold_shares(folded, 5).withColumn("share", rounded("share"))


# One feature per part: its retail price in hundreds; target: age minus prediction; tissue: brand; fold: key mod 5.
SIMPLE_SQL = f"""{t.PARTS_SQL}, rows AS (
  SELECT p.p_partkey, p.p_brand AS "Tissue", p.project_id, p.y, p.y - p.yhat AS target, p.yhat, p_retailprice / 100 AS x,
         p.p_partkey % 5 AS fold FROM parts p JOIN part USING (p_partkey))"""
SUMS = "count(*) AS n, sum(x) AS sx, sum(target) AS sy, sum(x * x) AS sxx, sum(x * target) AS sxy"


def _simple(spark, sf):
    price = t.table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    y, yhat = F.col("p_size").cast("double"), (F.col("p_size") + F.col("p_partkey") % 7 - 3).cast("double")
    return price.select("p_partkey", F.col("p_brand").alias("Tissue"), F.col("p_type").alias("project_id"), y.alias("y"),
                        (y - yhat).alias("target"), yhat.alias("yhat"), (F.col("p_retailprice") / 100).alias("x"),
                        (F.col("p_partkey") % 5).alias("fold"))


@query("agg13_sufficient_stats", f"""WITH {SIMPLE_SQL}
SELECT "Tissue", fold, count(*) AS n, round(sum(x), 4) + 0.0 AS sx, round(sum(target), 4) + 0.0 AS sy,
       round(sum(x * x), 4) + 0.0 AS sxx, round(sum(x * target), 4) + 0.0 AS sxy FROM rows GROUP BY 1, 2""")
def agg13(spark, sf):
    stats = simple_stats(_simple(spark, sf), ["Tissue", "fold"], "x", "target")
    return stats.withColumns({c: rounded(c, 4) for c in ("sx", "sy", "sxx", "sxy")})


@query("agg13_gram", f"""WITH {t.CELLS_SQL}, z AS (
  SELECT sample_id, "Tissue", 0 AS k, 1.0::DOUBLE AS v FROM samples
  UNION ALL SELECT sample_id, "Tissue", dim + 1, coalesce(value, 0) FROM cells
  UNION ALL SELECT sample_id, "Tissue", {t.DIMS + 1}, "Age" FROM samples)
SELECT a."Tissue", a.k AS i, b.k AS j, round(sum(a.v * b.v), 4) + 0.0 AS v
FROM z a JOIN z b ON a.sample_id = b.sample_id AND a.k <= b.k GROUP BY ALL""")
def agg13_gram(spark, sf):
    """Gram matrix of all features and the age, per tissue."""
    return gram(t.packed(spark, sf, with_meta=True), ["Tissue"], t.DIMS, "Age", [0.0] * t.DIMS).withColumn("v", rounded("v", 4))


RIDGE = "(sxy - sx * sy / n) / (sxx - sx * sx / n + 1.0)"


@query("fit2_ridge_simple", f"""WITH {SIMPLE_SQL}, s AS (SELECT {SUMS} FROM rows)
SELECT n, round({RIDGE}, 6) + 0.0 AS weight, round((sy - {RIDGE} * sx) / n, 6) + 0.0 AS intercept FROM s""")
def fit2(spark, sf):
    model = linear.fit_simple_ridge(simple_stats(_simple(spark, sf), [], "x", "target"), 1.0)
    return model.select("n", rounded("weight").alias("weight"), rounded("intercept").alias("intercept"))


@query("fit2_ridge_two_features", """
WITH s AS (
  SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS ma, avg(l_discount) AS mb, avg(l_extendedprice / 1000) AS my,
    var_pop(l_quantity) * count(*) + 1 AS saa, var_pop(l_discount) * count(*) + 1 AS sbb,
    covar_pop(l_quantity, l_discount) * count(*) AS sab, covar_pop(l_quantity, l_extendedprice / 1000) * count(*) AS say,
    covar_pop(l_discount, l_extendedprice / 1000) * count(*) AS sby
  FROM lineitem GROUP BY 1), w AS (
  SELECT *, (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS wa, (saa * sby - sab * say) / (saa * sbb - sab * sab) AS wb FROM s)
SELECT l_returnflag, n, round(wa, 6) + 0.0 AS w_quantity, round(wb, 6) + 0.0 AS w_discount,
       round(my - wa * ma - wb * mb, 6) + 0.0 AS intercept FROM w""")
def fit2_two(spark, sf):
    """Ridge from the distributed Gram matrix, per return flag."""
    lines = t.table(spark, sf, "lineitem").select(
        "l_returnflag", F.array("l_quantity", "l_discount").alias("values"), (F.col("l_extendedprice") / 1000).alias("y"))
    models = linear.fit_ridge(gram(lines, ["l_returnflag"], 2, "y"), ["l_returnflag"], 2, 1.0)
    return models.select("l_returnflag", "n", rounded(F.get("weights", F.lit(0))).alias("w_quantity"),
                         rounded(F.get("weights", F.lit(1))).alias("w_discount"), rounded("intercept").alias("intercept"))


PULL, CURVE = "((sxy - sx * sy / n) / n)", "((sxx - sx * sx / n) / n)"
ENET = f"(sign({PULL}) * greatest(abs({PULL}) - 0.01 * 0.5, 0) / ({CURVE} + 0.01 * 0.5))"


@query("fit1_elastic_net_simple", f"""WITH {SIMPLE_SQL}, s AS (SELECT "Tissue", {SUMS} FROM rows GROUP BY 1)
SELECT "Tissue", n, round({ENET}, 6) + 0.0 AS weight, round((sy - {ENET} * sx) / n, 6) + 0.0 AS intercept FROM s""")
def fit1_simple(spark, sf):
    model = linear.fit_simple_elastic_net(simple_stats(_simple(spark, sf), ["Tissue"], "x", "target"), 0.01, 0.5)
    return model.select("Tissue", "n", rounded("weight").alias("weight"), rounded("intercept").alias("intercept"))


@query("fit1_elastic_net_gram", f"""WITH {SIMPLE_SQL}, s AS (SELECT "Tissue", {SUMS} FROM rows GROUP BY 1)
SELECT "Tissue", n, round({ENET}, 5) + 0.0 AS weight FROM s""")
def fit1_gram(spark, sf):
    """The iterative solver must agree with the closed form for one feature."""
    rows = _simple(spark, sf).withColumn("values", F.array("x"))
    models = linear.fit_elastic_net(gram(rows, ["Tissue"], 1, "target"), ["Tissue"], 1, 0.01, 0.5)
    return models.select("Tissue", "n", rounded(F.get("weights", F.lit(0)), 5).alias("weight"))


FAMILY_SQL = f"""{SIMPLE_SQL}, s AS (
  SELECT "Tissue" AS model_key, {SUMS} FROM rows GROUP BY 1 HAVING count(*) >= 80
  UNION ALL SELECT 'Global', {SUMS} FROM rows), family AS (
  SELECT model_key, n, {RIDGE} AS weight, (sy - {RIDGE} * sx) / n AS intercept FROM s)"""


def _family(spark, sf):
    per_tissue = simple_stats(_simple(spark, sf), ["Tissue"], "x", "target")
    pooled = per_tissue.agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")]).withColumn("model_key", F.lit("Global"))
    own = per_tissue.filter("n >= 80").withColumnRenamed("Tissue", "model_key")
    return linear.fit_simple_ridge(own.unionByName(pooled), 1.0)


@query("fit3_tissue_family", f"""WITH {FAMILY_SQL}
SELECT model_key, n, round(weight, 6) + 0.0 AS weight, round(intercept, 6) + 0.0 AS intercept FROM family""")
def fit3(spark, sf):
    return _family(spark, sf).select("model_key", "n", rounded("weight").alias("weight"), rounded("intercept").alias("intercept"))


@query("fit3_tissue_family_gram", f"""WITH {FAMILY_SQL}
SELECT model_key, n, round(weight, 6) + 0.0 AS weight, round(intercept, 6) + 0.0 AS intercept FROM family""")
def fit3_gram(spark, sf):
    rows = _simple(spark, sf).withColumn("values", F.array("x"))
    models = linear.fit_tissue_family(settle(gram(rows, ["Tissue"], 1, "target")), 1, 1.0, min_samples=80)
    return models.select("model_key", "n", rounded(F.get("weights", F.lit(0))).alias("weight"), rounded("intercept").alias("intercept"))


@query("prd3_simple_fusion", f"""WITH {FAMILY_SQL}
SELECT p_partkey, r."Tissue", round(m.intercept + m.weight * r.x, 6) + 0.0 AS pred_residual_stage3,
       round(r.yhat + m.intercept + m.weight * r.x, 6) + 0.0 AS fused_age
FROM rows r JOIN family m
  ON m.model_key = CASE WHEN r."Tissue" IN (SELECT model_key FROM family) THEN r."Tissue" ELSE 'Global' END""")
def prd3_simple(spark, sf):
    """Score with the tissue's own model or the global one."""
    scored = score_simple_with_fallback(_simple(spark, sf), _family(spark, sf), "x")
    return scored.select("p_partkey", "Tissue", rounded("correction").alias("pred_residual_stage3"),
                         rounded(F.col("yhat") + F.col("correction")).alias("fused_age"))


TRAIN_SQL = f"""{SIMPLE_SQL}, f AS (SELECT fold, {SUMS} FROM rows GROUP BY 1), total AS (SELECT {SUMS} FROM rows), train AS (
  SELECT fold, t.n - f.n AS n, t.sx - f.sx AS sx, t.sy - f.sy AS sy, t.sxx - f.sxx AS sxx, t.sxy - f.sxy AS sxy
  FROM f, total t)"""


def _train_stats(spark, sf):
    return all_but_each_fold(simple_stats(_simple(spark, sf), ["fold"], "x", "target"), [], ["n", "sx", "sy", "sxx", "sxy"])


@query("oof1_simple", f"""WITH {TRAIN_SQL}, m AS (SELECT fold, {RIDGE} AS w, (sy - {RIDGE} * sx) / n AS b FROM train)
SELECT p_partkey, round(b + w * x, 6) + 0.0 AS oof FROM rows JOIN m USING (fold)""")
def oof1_simple(spark, sf):
    """Each fold is scored by the model of all others, in one join."""
    models = linear.fit_simple_ridge(_train_stats(spark, sf), 1.0).select("fold", "weight", "intercept")
    rows = _simple(spark, sf).join(settle(models), "fold")
    return rows.select("p_partkey", rounded(F.col("intercept") + F.col("weight") * F.col("x")).alias("oof"))


GRID = [0.1, 1.0, 10.0, 1000.0]
GRID_SQL = "grid AS (SELECT CAST(row_number() OVER (ORDER BY alpha) - 1 AS INTEGER) AS trial, alpha FROM (VALUES (0.1), (1), (10), (1000)) v(alpha))"
RIDGE_A = "(sxy - sx * sy / n) / (sxx - sx * sx / n + alpha)"


@query("sel4_ridge_search", f"""WITH {TRAIN_SQL}, {GRID_SQL}, m AS (
  SELECT trial, alpha, fold, {RIDGE_A} AS w, (sy - {RIDGE_A} * sx) / n AS b FROM train, grid), scores AS (
  SELECT trial, alpha, fold, avg(abs(target - b - w * x)) AS mae FROM rows JOIN m USING (fold) GROUP BY ALL)
SELECT trial, round(CAST(alpha AS DOUBLE), 6) + 0.0 AS alpha, round(avg(mae), 6) + 0.0 AS score FROM scores GROUP BY ALL""")
def sel4(spark, sf):
    """All candidates x folds from the sums of one pass, scored in one more."""
    from ..operators.search import search_ridge

    rows = settle(_simple(spark, sf).select("fold", "target", F.array("x").alias("values")))
    per_fold = settle(gram(rows, ["fold"], 1, "target").withColumn("fold", F.col("fold").cast("int")))
    grid = grid_candidates(spark, alpha=GRID)
    candidates = [{"trial": r["trial"], "alpha": r["alpha"], "use": [0]} for r in grid.collect()]
    report = search_ridge(rows, per_fold, 1, candidates, "target", 5)
    scores = report.groupBy(F.col("job").alias("trial")).agg(rounded(F.avg("mae")).alias("score"))
    return scores.join(grid, "trial").withColumn("alpha", rounded("alpha"))


SPACE = {"alpha": ("log", 1e-4, 1.0), "l1": ("uniform", 0.1, 1.0), "min_cap": ("int", 10, 60), "max_cap": ("int", 200, 1000),
         "mult": ("uniform", 0.5, 2.5)}


def _draw_sql(name: str) -> str:
    return f"(CAST('0x' || substr(md5('{name}:' || trial || '|42'), 1, 8) AS BIGINT) / 4294967296.0)"


@query("sel2_candidates", f"""WITH {t.ORDERS_SQL}, c AS (
  SELECT median(n) AS m FROM (SELECT count(*) AS n FROM order_samples GROUP BY "Tissue")), draws AS (
  SELECT CAST(trial AS INTEGER) AS trial, exp(ln(0.0001) + {_draw_sql('alpha')} * (ln(1.0) - ln(0.0001))) AS alpha,
         0.1 + {_draw_sql('l1')} * 0.9 AS l1, CAST(10 + floor({_draw_sql('min_cap')} * 51) AS INTEGER) AS min_cap,
         CAST(200 + floor({_draw_sql('max_cap')} * 801) AS INTEGER) AS max_cap, 0.5 + {_draw_sql('mult')} * 2.0 AS mult
  FROM range(50) r(trial))
SELECT trial, round(alpha, 6) + 0.0 AS alpha, round(l1, 6) + 0.0 AS l1, min_cap, max_cap, round(mult, 6) + 0.0 AS mult,
       CAST(trunc(least(greatest(m * mult, min_cap), max_cap)) AS INTEGER) AS target_n FROM draws, c""")
def sel2(spark, sf):
    """Seeded draws, each with the sample size its sampler settings give on the order table."""
    draws = random_candidates(spark, 50, SPACE, 42)
    sized = folds.fold_targets(t.order_samples(spark, sf).withColumn("held_out", F.lit(0)), draws)
    return sized.drop("held_out").withColumns({c: rounded(c) for c in ("alpha", "l1", "mult")})


@query("sel2_grid", """
WITH n AS (SELECT count(*) AS n_rows FROM lineitem), g AS (
  SELECT CAST(row_number() OVER (ORDER BY alpha, use_pcs) - 1 AS INTEGER) AS trial, CAST(alpha AS DOUBLE) AS alpha, use_pcs
  FROM (VALUES (0.1), (1), (10)) a(alpha), (VALUES (false), (true)) p(use_pcs))
SELECT trial, alpha, use_pcs, alpha / n_rows AS penalty_per_row FROM g, n""")
def sel2_grid(spark, sf):
    """All combinations of lists, with the ridge penalty per row of the line table."""
    n = t.table(spark, sf, "lineitem").count()
    return grid_candidates(spark, alpha=[0.1, 1.0, 10.0], use_pcs=[False, True]).withColumn("penalty_per_row", F.col("alpha") / n)


WEIGHTED_SQL = f"""{t.CELLS_SQL}, {t.HALLMARKS_SQL}, coef AS (
  SELECT hallmark, feature, CAST(pos % 5 - 2 AS DOUBLE) / 4 AS weight FROM hallmark_features)"""
INVERSE = "CASE WHEN s < 0 THEN 21 * exp(s) - 1 ELSE s * 21 + 20 END"


@query("prd2_expert_scores", f"""WITH {WEIGHTED_SQL}, sums AS (
  SELECT c.sample_id, w.hallmark, 0.25 + sum(coalesce(c.value, 0) * w.weight) AS s
  FROM cells c JOIN coef w USING (feature) GROUP BY 1, 2)
SELECT sample_id, round(max({INVERSE}) FILTER (hallmark = 'H1'), 5) + 0.0 AS "pred_resid_H1",
  round(max({INVERSE}) FILTER (hallmark = 'H2'), 5) + 0.0 AS "pred_resid_H2",
  round(max({INVERSE}) FILTER (hallmark = 'H3'), 5) + 0.0 AS "pred_resid_H3" FROM sums GROUP BY 1""")
def prd2(spark, sf):
    """Experts as coefficient tables: one join and sum for all of them, back to years, one column each."""
    from ..operators.align import spread_experts
    from ..operators.score import score_cells_by_model

    coef = t.hallmark_features(spark).withColumn("weight", (F.col("pos") % 5 - 2).cast("double") / 4)
    bases = coef.select("hallmark").distinct().withColumn("intercept", F.lit(0.25))
    cells = t.cells(spark, sf).withColumn("value", F.coalesce(F.col("value").cast("double"), F.lit(0.0)))
    scored = score_cells_by_model(cells, coef, bases, "hallmark").withColumn("pred", scale_to_age(F.col("score")))
    wide = spread_experts(scored, ["H1", "H2", "H3"])
    return wide.select("sample_id", *[rounded(c, 5).alias(c) for c in wide.columns if c != "sample_id"])


@query("prd1_global_score", f"""WITH {t.FILLED_SQL}, {t.HALLMARKS_SQL}, coef AS (
  SELECT feature, CAST(dim % 9 - 4 AS DOUBLE) / 8 AS weight FROM dims), sums AS (
  SELECT sample_id, -0.5 + sum(f.value * c.weight) AS s FROM filled f JOIN coef c USING (feature) GROUP BY 1)
SELECT s.sample_id, s."Age", s."Tissue", s.project_id, round({INVERSE.replace('s ', 'q.s ').replace('(s)', '(q.s)')}, 5) + 0.0 AS pred_age_stage1
FROM samples s JOIN sums q USING (sample_id)""")
def prd1(spark, sf):
    """Impute, score packed rows with one weight vector, back to years."""
    import numpy as np

    from ..functions.scalar import AGE_TARGET
    from ..operators.score import score_packed

    weights = np.array([[(d % 9 - 4) / 8] for d in range(t.DIMS)])
    scored = score_packed(t.packed(spark, sf, with_meta=True), {(): (np.array([-0.5]), weights)}, ["pred_age_stage1"], t.DIMS,
                          ["sample_id", "Age", "Tissue", "project_id"], fills=t.fills(spark, sf),
                          target=AGE_TARGET)
    return scored.withColumn("pred_age_stage1", rounded("pred_age_stage1", 5))


@query("imp1_performance_table", f"""WITH {t.CELLS_SQL}, {t.HALLMARKS_SQL}, scored AS (
  SELECT h.hallmark, c."Age" AS y, 45 + 20 * avg(c.value) AS yhat
  FROM cells c JOIN hallmark_features h USING (feature) WHERE c.value IS NOT NULL GROUP BY h.hallmark, c.sample_id, c."Age")
{METRICS_SQL.format(key="hallmark,", group="GROUP BY hallmark")}""")
def imp1(spark, sf):
    """Metrics per hallmark of a naive expert (the mean of its features)."""
    cells = t.cells(spark, sf, with_meta=True).filter("value is not null").join(settle(t.hallmark_features(spark)), "feature")
    scored = cells.groupBy("hallmark", "sample_id", F.col("Age").alias("y")).agg(
        (45 + 20 * F.avg(F.col("value").cast("double"))).alias("yhat"))
    return regression_metrics(settle(scored), ["hallmark"])


@query("agg6_median_error", """
SELECT l_linestatus, round(median(abs(l_quantity - l_extendedprice / 2000)), 6) + 0.0 AS median FROM lineitem GROUP BY 1""")
def agg6_median(spark, sf):
    error = F.abs(F.col("l_quantity") - F.col("l_extendedprice") / 2000).alias("e")
    return exact_median(t.table(spark, sf, "lineitem").select("l_linestatus", error), ["l_linestatus"], "e",
                        group_rows=1000).withColumn("median", rounded("median"))


@query("agg1_fold_medians", f"""WITH {t.CELLS_SQL}, outside AS (
  SELECT h.held_out, c.feature, c.dim, c.value FROM cells c JOIN (SELECT CAST(x AS INTEGER) AS held_out FROM range(6) r(x)) h
    ON CAST(c.sample_id AS BIGINT) % 5 <> h.held_out)
SELECT held_out, dim, round(coalesce(median(value), 0), 6) + 0.0 AS fill FROM outside GROUP BY held_out, dim""")
def agg1_folds(spark, sf):
    """Medians of the rows outside each of five folds, and of all rows (set 5), from one set of grids."""
    rows = t.packed(spark, sf).withColumn("fold", (F.col("sample_id").cast("long") % 5).cast("int"))
    fills = fold_fills(rows, t.DIMS, "fold", 5)
    table = [(h, d, float(v)) for (h, d), v in np.ndenumerate(fills)]
    return spark.createDataFrame(table, "held_out int, dim int, fill double").withColumn("fill", rounded("fill"))


_UNIT_SQL = f"""WITH {t.FILLED_SQL}, rows AS (
  SELECT "Tissue", {t.Y_SQL} AS y, max(value) FILTER (dim = 0) AS a, max(value) FILTER (dim = 1) AS b
  FROM filled WHERE dim < 2 GROUP BY sample_id, "Tissue", "Age"), sums AS (
  SELECT "Tissue", count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb,
         covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS "by" FROM rows GROUP BY "Tissue")"""


def _two_features(spark, sf):
    rows = impute_packed(t.packed(spark, sf, with_meta=True), t.fills(spark, sf)).withColumn("y", AGE_TARGET.forward(F.col("Age")))
    return pick_features(rows, [0, 1])


@query("fn10_standardized_ridge", _UNIT_SQL + """, solved AS (
  SELECT *, n + 2.0 AS d, n * ab / (sa * sb) AS c, n * ay / sa AS ra, n * "by" / sb AS rb FROM sums), weights AS (
  SELECT *, (d * ra - c * rb) / (d * d - c * c) / sa AS wa, (d * rb - c * ra) / (d * d - c * c) / sb AS wb FROM solved)
SELECT "Tissue", round(wa, 6) + 0.0 AS w0, round(wb, 6) + 0.0 AS w1, round(my - wa * ma - wb * mb, 6) + 0.0 AS intercept FROM weights""")
def fn10_ridge(spark, sf):
    """Ridge of two features at unit scale, per tissue, by a congruence of the Gram statistics."""
    models = fit_ridge(gram(_two_features(spark, sf), ["Tissue"], 2, "y"), ["Tissue"], 2, 2.0, standardize=True)
    return models.select("Tissue", *[rounded(F.get("weights", F.lit(i))).alias(f"w{i}") for i in (0, 1)], rounded("intercept").alias("intercept"))


@query("fn10_stored_scaling", _UNIT_SQL + """, unit AS (
  SELECT *, sign(ay / sa) * greatest(abs(ay / sa) - 0.01 * 0.5, 0) / (1 + 0.01 * 0.5) AS u FROM sums)
SELECT "Tissue" AS model_key, round(ma, 6) + 0.0 AS mean, round(sa, 6) + 0.0 AS scale, round(u, 6) + 0.0 AS unit_weight,
       round(my, 6) + 0.0 AS unit_intercept, round(u / sa, 6) + 0.0 AS weight, round(my - u / sa * ma, 6) + 0.0 AS intercept FROM unit""")
def fn10_stored(spark, sf):
    """An elastic net per tissue, trained and stored at unit scale, and what scoring loads: scale folded into the weights."""
    stats = settle(gram(pick_features(_two_features(spark, sf), [0]), ["Tissue"], 1, "y"), "gram")
    fitted = fit_elastic_net(stats, ["Tissue"], 1, 0.01, 0.5, standardize=True).join(scale_table(stats, ["Tissue"]), "Tissue")
    models = [{"model_key": r["Tissue"], "intercept": r["intercept"], "weights": r["weights"], "use": [0], "mean": np.array([r["mean"]]),
               "scale": np.array([r["scale"]])} for r in fitted.collect()]
    store = ModelStore(spark, scratch_path(spark, "store"))
    store.save_fitted("unit", models, t.FEATURES[:1])
    loaded = spark.createDataFrame([(m["model_key"], float(m["weights"].sum()), float(m["intercept"])) for m in store.load_fitted("unit")],
                                   "model_key string, weight double, intercept double")
    kept = store.load("unit_scaling").join(store.load("unit_coefficients"), ["model_key", "idx", "feature"]).join(
        store.load("unit_intercepts").withColumnRenamed("intercept", "unit_intercept"), "model_key")
    names = {"mean": "mean", "scale": "scale", "unit_weight": kept["weight"], "unit_intercept": "unit_intercept", "weight": loaded["weight"],
             "intercept": loaded["intercept"]}
    both = kept.join(loaded, "model_key")
    return both.select(loaded["model_key"], *[rounded(c).alias(n) for n, c in names.items()])


@query("trn4_tissue_offsets", f"""WITH {t.SAMPLES_SQL}, rows AS (
  SELECT "Tissue", {t.Y_SQL} AS y, CAST(embedding[1] AS DOUBLE) AS x FROM samples), g AS (
  SELECT "Tissue", count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM rows GROUP BY "Tissue"), e AS (
  SELECT sum(n * 3.0 / (n + 3.0)) AS a, sum(sx * 3.0 / (n + 3.0)) AS b, sum(sxx - sx * sx / (n + 3.0)) + 3.0 AS c,
         sum(sy * 3.0 / (n + 3.0)) AS u, sum(sxy - sx * sy / (n + 3.0)) AS v FROM g), s AS (
  SELECT (c * u - b * v) / (a * c - b * b) AS base, (a * v - b * u) / (a * c - b * b) AS w FROM e)
SELECT "Tissue", round(base, 6) + 0.0 AS intercept, round(w, 6) + 0.0 AS weight,
       round((sy - n * base - sx * w) / (n + 3.0), 6) + 0.0 AS "offset" FROM g, s""")
def trn4_offsets(spark, sf):
    """Ridge of one feature and an indicator per tissue, the indicators taken out of the equations."""
    rows = t.samples(spark, sf).join(t.table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("sample_id"), F.slice("embedding", 1, 1).alias("values")), "sample_id")
    stats = gram(rows.withColumn("y", AGE_TARGET.forward(F.col("Age"))), ["Tissue"], 1, "y")
    fitted = fit_arrowhead(stats, [], 1, [{"alpha": 3.0}])
    each = fitted.select("intercept", F.get("weights", F.lit(0)).alias("weight"), F.explode(F.arrays_zip("tissues", "offsets")).alias("t"))
    return each.select(F.col("t.tissues").alias("Tissue"), rounded("intercept").alias("intercept"), rounded("weight").alias("weight"),
                       rounded("t.offsets").alias("offset"))
