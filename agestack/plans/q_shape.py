"""Queries: projections, filters, joins, sets, order, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import align, folds, linear
from ..operators.ranking import number_rows
from ..operators.search import best_trial, trial_scores
from ..operators.score import fused_age, model_key_with_fallback, residual, score_cells, score_joined
from ..schema import SUFFIXES
from ..session import scratch_path, settle
from ..sources.store import ModelStore
from . import standins as t
from .registry import query, rounded

MODALITIES = list(SUFFIXES)


@query("prj1_modality_suffix", f"""WITH {t.CELLS_SQL}
SELECT modality, feature, count(*) AS n FROM cells WHERE modality <> 'pc' GROUP BY modality, feature""")
def prj1(spark, sf):
    """Even sites already carry the suffix, odd ones do not."""
    cells = t.cells(spark, sf).filter("modality <> 'pc'")
    bare = F.when(F.col("dim") % 2 == 0, F.col("feature")).otherwise(F.split_part("feature", F.lit("_"), F.lit(1)))
    counted = cells.select("modality", bare.alias("feature")).groupBy("modality", "feature").agg(F.count("*").alias("n"))
    parts = [align.suffix_features(counted.filter(F.col("modality") == m), m) for m in MODALITIES]
    return align.stack_modalities(parts)


@query("prj2_numeric_features", """
SELECT l_orderkey, l_linenumber, feature, value FROM (
  SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
UNPIVOT (value FOR feature IN (l_quantity, l_extendedprice, l_discount, l_tax))""")
def prj2(spark, sf):
    """Numeric columns that are not metadata, unpivoted; text and dates stay behind."""
    df = t.table(spark, sf, "lineitem").drop("l_partkey", "l_suppkey")
    keys = ["l_orderkey", "l_linenumber"]
    names = [c for c in align.feature_columns(df) if c not in keys]
    return df.unpivot(keys, names, "feature", "value")


@query("prj3_float32", """
SELECT l_returnflag, CAST(l_extendedprice AS FLOAT) AS l_extendedprice, CAST(l_tax AS FLOAT) AS l_tax FROM lineitem""")
def prj3(spark, sf):
    return align.to_float32(t.table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice", "l_tax"))


@query("prj4_drop_overlap", """
SELECT c_custkey, c_name AS name, c_acctbal, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def prj4(spark, sf):
    """Both sides have a column ``name``; the left one stays."""
    left = t.table(spark, sf, "customer").withColumnsRenamed({"c_name": "name", "c_nationkey": "key"})
    right = t.table(spark, sf, "nation").withColumnsRenamed({"n_nationkey": "key"}).withColumn("name", F.lit("x"))
    joined = left.join(align.drop_overlap(left, right, "key"), "key")
    return joined.select("c_custkey", "name", "c_acctbal", "n_name")


@query("prj5_keep_features", f"""WITH {t.CELLS_SQL}, {t.HALLMARKS_SQL}
SELECT sample_id, feature, round(value, 6) + 0.0 AS value FROM cells
WHERE feature IN (SELECT feature FROM hallmark_features WHERE hallmark = 'H2')""")
def prj5(spark, sf):
    wanted = t.hallmark_features(spark).filter("hallmark = 'H2'")
    kept = align.keep_features(t.cells(spark, sf), wanted)
    return kept.select("sample_id", "feature", rounded(F.col("value").cast("double")).alias("value"))


@query("prj5_select_wide", f"""WITH {t.SAMPLES_SQL}
SELECT sample_id, project_id, "Tissue", "Sex", "Is_Healthy", embedding[1] AS cg00000000, embedding[4] AS cg00000003
FROM samples""")
def prj5_wide(spark, sf):
    df = t.table(spark, sf, "embeddings")
    wide = t.samples(spark, sf).join(df.select(
        F.col("vec_id").cast("string").alias("sample_id"),
        *[F.get("embedding", F.lit(i)).alias(f"cg{i:08d}") for i in range(20)]), "sample_id")
    return align.select_features(wide, ["cg00000000", "cg00000003", "cg99999999"])


@query("prj6_align_features", f"""WITH {t.CELLS_SQL}, wanted(feature) AS (
  VALUES ('cg00000001_beta'), ('cg00000002_chalm'), ('cg77777777_beta'), ('RF_PC2'))
SELECT s.sample_id, w.feature, round(coalesce(c.value, 0), 6) + 0.0 AS value
FROM samples s CROSS JOIN wanted w LEFT JOIN cells c ON c.sample_id = s.sample_id AND c.feature = w.feature""")
def prj6(spark, sf):
    """Packed rows laid out in a model's feature order; a feature the data lacks is 0."""
    wanted = ["cg00000001_beta", "cg00000002_chalm", "cg77777777_beta", "RF_PC2"]
    at = [t.FEATURES.index(f) if f in t.FEATURES else -1 for f in wanted]
    picked = F.transform(F.lit(at), lambda i: F.coalesce(F.get("values", i).cast("double"), F.lit(0.0)))
    df = t.packed(spark, sf).select("sample_id", picked.alias("values"))
    return align.unpack(df, wanted).select("sample_id", "feature", rounded("value").alias("value"))


@query("prj6_align_wide", f"""WITH {t.SAMPLES_SQL}
SELECT sample_id, round(CAST(embedding[61] AS DOUBLE), 6) + 0.0 AS "RF_PC1", 0.0::DOUBLE AS "RF_PC9",
       CAST("Tissue" = 'T3' AS INTEGER) AS "Tissue_T3", CAST("Tissue" = 'Tnew' AS INTEGER) AS "Tissue_Tnew"
FROM samples""")
def prj6_wide(spark, sf):
    """Absent columns become 0; tissue indicators are rebuilt from the tissue."""
    wanted = ["RF_PC1", "RF_PC9", "Tissue_T3", "Tissue_Tnew"]
    df = align.align_columns(t.context(spark, sf), wanted)
    return df.select("sample_id", rounded("RF_PC1").alias("RF_PC1"), *wanted[1:])


@query("prj7_hallmark_features", f"""WITH {t.CELLS_SQL}, {t.HALLMARKS_SQL}
SELECT h.hallmark, h.pos, h.feature, h.dim AS idx, count(c.value) AS n_values
FROM hallmark_features h JOIN cells c USING (feature) GROUP BY ALL""")
def prj7(spark, sf):
    """Features of each hallmark with their column and the number of values they hold."""
    counted = t.cells(spark, sf).groupBy("feature").agg(F.count("value").alias("n_values"))
    mapped = align.hallmark_features(t.hallmark_features(spark), t.feature_index(spark))
    return mapped.join(counted, "feature").select("hallmark", "pos", "feature", "idx", "n_values")


@query("prj8_expand_modalities", f"""WITH {t.CELLS_SQL}, {t.HALLMARKS_SQL}
SELECT DISTINCT hallmark, pos, feature FROM hallmark_features JOIN cells USING (feature) WHERE value IS NOT NULL""")
def prj8(spark, sf):
    """Only features the data has values for."""
    available = t.cells(spark, sf).filter("value is not null").select("feature").distinct()
    return align.expand_over_modalities(t.hallmark_sites(spark), available)


@query("prj9_one_hot", """
SELECT c_custkey, CAST(c_mktsegment = 'AUTOMOBILE' AS INTEGER) AS "Tissue_AUTOMOBILE",
       CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS "Tissue_BUILDING",
       CAST(c_mktsegment = 'FURNITURE' AS INTEGER) AS "Tissue_FURNITURE",
       CAST(c_mktsegment = 'HOUSEHOLD' AS INTEGER) AS "Tissue_HOUSEHOLD",
       CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS "Tissue_MACHINERY" FROM customer""")
def prj9(spark, sf):
    df = t.table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("Tissue"))
    values = sorted(r[0] for r in df.select("Tissue").distinct().collect())
    return align.one_hot(df, values).drop("Tissue")


@query("prj10_output_order", f"""WITH {t.PARTS_SQL}
SELECT CAST(p_partkey AS VARCHAR) AS sample_id, y AS "Age", p_brand AS "Tissue", yhat AS fused_age, yhat AS pred_age_stage1,
       project_id, y AS pred_resid_h1 FROM parts""")
def prj10(spark, sf):
    df = t.parts(spark, sf).select(
        F.col("y").alias("pred_resid_h1"), F.lit(1).alias("scratch"), F.col("yhat").alias("pred_age_stage1"),
        "project_id", F.col("yhat").alias("fused_age"), F.col("p_brand").alias("Tissue"), F.col("y").alias("Age"),
        F.col("p_partkey").cast("string").alias("sample_id"))
    return align.order_output(df, align.FIRST_SCORING, rest=False)


@query("prj11_expert_columns", f"""WITH {t.CELLS_SQL}, {t.HALLMARKS_SQL}, sums AS (
  SELECT c.sample_id, h.hallmark, sum(coalesce(c.value, 0)) AS pred FROM cells c JOIN hallmark_features h USING (feature)
  GROUP BY 1, 2)
SELECT sample_id, round(max(pred) FILTER (hallmark = 'H1'), 6) + 0.0 AS "pred_resid_H1",
       round(max(pred) FILTER (hallmark = 'H2'), 6) + 0.0 AS "pred_resid_H2",
       round(max(pred) FILTER (hallmark = 'H3'), 6) + 0.0 AS "pred_resid_H3" FROM sums GROUP BY sample_id""")
def prj11(spark, sf):
    cells = t.cells(spark, sf).join(settle(t.hallmark_features(spark)), "feature")
    value = F.coalesce(F.col("value").cast("double"), F.lit(0.0))
    wide = align.spread_experts(cells.groupBy("sample_id", "hallmark").agg(F.sum(value).alias("pred")), ["H1", "H2", "H3"])
    return wide.select("sample_id", *[rounded(c).alias(c) for c in wide.columns if c != "sample_id"])


@query("flt1_healthy_only", f"""WITH {t.SAMPLES_SQL}
SELECT sample_id, "Tissue" FROM samples WHERE "Is_Healthy\"""")
def flt1(spark, sf):
    return folds.healthy_filter(t.samples(spark, sf)).select("sample_id", "Tissue")


@query("flt2_min_cohorts", """
WITH tagged AS (SELECT p_partkey, p_brand AS "Tissue", p_type || (p_size % 10) AS project_id FROM part)
SELECT p_partkey, "Tissue", project_id FROM tagged
WHERE "Tissue" IN (SELECT "Tissue" FROM tagged GROUP BY 1 HAVING count(DISTINCT project_id) >= 45)""")
def flt2(spark, sf):
    project = F.concat("p_type", (F.col("p_size") % 10).cast("string"))
    df = t.table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("Tissue"), project.alias("project_id"))
    return folds.keep_valid_tissues(df, 45).select("p_partkey", "Tissue", "project_id")


@query("flt3_tissue_models", f"""WITH {t.SAMPLES_SQL}
SELECT "Tissue", count(*) AS n FROM samples GROUP BY 1 HAVING count(*) >= 50""")
def flt3(spark, sf):
    return folds.tissues_with_own_model(t.samples(spark, sf), 50)


# Mean value per feature, kept where it stands out, serves as a weight table that comes from the data.
WEIGHTS_SQL = """weights AS (
  SELECT feature, CASE WHEN abs(avg(value)) < 0.01 THEN 0.0 ELSE round(avg(value), 4) END AS weight
  FROM cells GROUP BY feature)"""


def _weights(spark, sf):
    mean = F.avg(F.col("value").cast("double"))
    weight = F.when(F.abs(mean) < 0.01, 0.0).otherwise(F.round(mean, 4))
    return t.cells(spark, sf).groupBy("feature").agg(weight.alias("weight"))


@query("flt4_active_coefficients", f"""WITH {t.CELLS_SQL}, {WEIGHTS_SQL}
SELECT feature, weight FROM weights WHERE abs(weight) > 1e-12""")
def flt4(spark, sf):
    return linear.active(_weights(spark, sf))


@query("flt5_fold_predicate", f"""WITH {t.SAMPLES_SQL}, folded AS (
  SELECT "Tissue", CAST(substr(project_id, 2) AS INTEGER) % 5 AS fold FROM samples)
SELECT "Tissue", count(*) FILTER (fold <> 2) AS n_train, count(*) FILTER (fold = 2) AS n_valid
FROM folded GROUP BY "Tissue\"""")
def flt5(spark, sf):
    project = F.substr("project_id", F.lit(2)).cast("int")
    df = t.samples(spark, sf).select("Tissue", (project % 5).alias("fold"))
    train = folds.training_rows(df, 2).groupBy("Tissue").agg(F.count("*").alias("n_train"))
    valid = folds.validation_rows(df, 2).groupBy("Tissue").agg(F.count("*").alias("n_valid"))
    return train.join(valid, "Tissue", "full").fillna(0, ["n_train", "n_valid"])


@query("jn1_inner_modalities", """
SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, o_totalprice, n_lines, c_acctbal
FROM orders JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
JOIN customer ON c_custkey = o_custkey""")
def jn1(spark, sf):
    """Order, line and customer measurements of the same sample, joined one after the other."""
    key = F.col("o_orderkey").cast("string").alias("sample_id")
    orders = t.table(spark, sf, "orders")
    lines = t.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("sample_id")).agg(
        F.count("*").alias("n_lines"))
    accounts = orders.join(t.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        key, "c_acctbal", F.col("o_totalprice"))
    return align.join_modalities(orders.select(key, "o_totalprice"), lines, None, accounts)


@query("jn1_complete_samples", f"""WITH {t.CELLS_SQL}
SELECT sample_id FROM cells WHERE value > 0.2 GROUP BY sample_id HAVING count(DISTINCT modality) = 4""")
def jn1_long(spark, sf):
    """Samples with at least one high value in every modality."""
    return align.complete_samples(t.cells(spark, sf).filter("value > 0.2D"), 4)


@query("jn3_join_stages", f"""WITH {t.PARTS_SQL}
SELECT p_partkey AS sample_id, y AS age, yhat AS pred_age_stage1, s.qty AS pred_resid_h1
FROM parts JOIN (SELECT l_partkey, round(avg(l_quantity), 6) + 0.0 AS qty FROM lineitem GROUP BY 1) s ON l_partkey = p_partkey""")
def jn3(spark, sf):
    first = t.parts(spark, sf).select(F.col("p_partkey").alias("sample_id"), F.col("y").alias("age"),
                                      F.col("yhat").alias("pred_age_stage1"))
    second = t.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("sample_id")).agg(
        rounded(F.avg("l_quantity")).alias("pred_resid_h1"), F.first(F.lit(0.0)).alias("age"))
    return align.join_stages(first, second, ["pred_resid_h1"])


CONTEXT_SQL = f"""{t.SAMPLES_SQL}, context AS (
  SELECT sample_id, round(CAST(embedding[61] AS DOUBLE), 6) + 0.0 AS "RF_PC1" FROM samples WHERE "Is_Healthy")"""


def _half_context(spark, sf):
    healthy = t.samples(spark, sf).filter("Is_Healthy").select("sample_id")
    return t.context(spark, sf).select("sample_id", rounded("RF_PC1").alias("RF_PC1")).join(healthy, "sample_id", "left_semi")


@query("jn4_context_training", f"""WITH {CONTEXT_SQL}
SELECT s.sample_id, "Tissue", "RF_PC1" FROM samples s JOIN context c USING (sample_id)""")
def jn4(spark, sf):
    return align.join_context(t.samples(spark, sf).select("sample_id", "Tissue"), _half_context(spark, sf), training=True)


@query("jn5_context_scoring", f"""WITH {CONTEXT_SQL}
SELECT s.sample_id, "Tissue", coalesce("RF_PC1", 0) AS "RF_PC1" FROM samples s LEFT JOIN context c USING (sample_id)""")
def jn5(spark, sf):
    return align.join_context(t.samples(spark, sf).select("sample_id", "Tissue"), _half_context(spark, sf), training=False)


@query("jn6_semi_join", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#2')""")
def jn6(spark, sf):
    wanted = t.table(spark, sf, "part").filter("p_brand = 'Brand#2'").select(F.col("p_partkey").alias("l_partkey"))
    return t.table(spark, sf, "lineitem").join(wanted, "l_partkey", "left_semi").select(
        "l_orderkey", "l_linenumber", "l_quantity")


@query("jn7_coverage", """
SELECT 'quality' AS modality, count(*) AS n_present, (SELECT count(*) FROM documents) - count(*) AS n_absent
FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
UNION ALL
SELECT 'good', count(*), (SELECT count(*) FROM documents) - count(*)
FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def jn7(spark, sf):
    """Documents as anchor, two label tables as modalities."""
    anchor = t.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("sample_id"))
    labels = t.table(spark, sf, "labels").withColumn("sample_id", F.col("doc_id").cast("string"))
    cells = labels.select("sample_id", F.lit("quality").alias("modality")).unionByName(
        labels.filter("quality = 1").select("sample_id", F.lit("good").alias("modality")))
    present = align.coverage(anchor, cells)
    return present.withColumn("n_absent", F.lit(anchor.count()) - F.col("n_present"))


@query("jn7_absent_ids", """
SELECT CAST(doc_id AS VARCHAR) AS sample_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def jn7_absent(spark, sf):
    anchor = t.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("sample_id"))
    labels = t.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("sample_id"))
    return align.absent_ids(anchor, labels)


@query("jn8_model_fallback", f"""WITH {t.SAMPLES_SQL}, own AS (
  SELECT "Tissue" FROM samples GROUP BY 1 HAVING count(*) >= 50)
SELECT sample_id, CASE WHEN "Tissue" IN (SELECT "Tissue" FROM own) THEN "Tissue" ELSE 'Global' END AS model_key FROM samples""")
def jn8(spark, sf):
    samples = t.samples(spark, sf)
    keys = folds.tissues_with_own_model(samples, 50).select(F.col("Tissue").alias("model_key"))
    return model_key_with_fallback(samples, keys).select("sample_id", "model_key")


@query("jn9_score_cells", f"""WITH {t.CELLS_SQL}, {WEIGHTS_SQL}
SELECT s.sample_id, round(0.5 + coalesce(sum(c.value * w.weight), 0), 6) + 0.0 AS score
FROM samples s JOIN cells c USING (sample_id) JOIN weights w USING (feature) GROUP BY 1""")
def jn9(spark, sf):
    weights = _weights(spark, sf).withColumns({"mean": F.lit(0.0), "scale": F.lit(1.0)})
    scored = score_cells(t.cells(spark, sf), weights, 0.5, t.samples(spark, sf))
    return scored.withColumn("score", rounded("score"))


@query("fn3_linear_score", f"""WITH {t.FILLED_SQL}, stats AS (
  SELECT feature, avg(value) AS mean, stddev_pop(value) AS scale FROM filled GROUP BY feature), {WEIGHTS_SQL}
SELECT f.sample_id, round(1.5 + sum((f.value - s.mean) / CASE WHEN s.scale = 0 THEN 1 ELSE s.scale END
                                    * coalesce(w.weight, 0)), 5) + 0.0 AS score
FROM filled f JOIN stats s USING (feature) JOIN weights w USING (feature) GROUP BY 1""")
def fn3(spark, sf):
    """Standardised features times weights plus intercept."""
    from ..operators.impute import fill_values, impute_cells

    cells = t.cells(spark, sf)
    filled = impute_cells(cells, fill_values(cells))
    stats = filled.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("scale"))
    weights = _weights(spark, sf).join(stats, "feature")
    return score_cells(filled, weights, 1.5, t.samples(spark, sf)).withColumn("score", rounded("score", 5))


@query("fn3_packed_score", f"""WITH {t.CELLS_SQL}
SELECT sample_id, round(sum(coalesce(value, 0) * (dim % 7 - 3)), 5) + 0.0 AS score FROM cells GROUP BY sample_id, "Tissue\"""")
def fn3_packed(spark, sf):
    """One model per tissue, joined to its rows; the product stays in the JVM."""
    rows = t.packed(spark, sf, with_meta=True)
    filled = F.transform("values", lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    models = rows.select("Tissue").distinct().withColumns({
        "intercept": F.lit(0.0), "weights": F.lit([float(d % 7 - 3) for d in range(t.DIMS)])})
    scored = score_joined(rows.withColumn("values", filled), models, ["Tissue"])
    return scored.select("sample_id", rounded("score", 5).alias("score"))


@query("srt1_sorted_ids", f"""WITH {t.SAMPLES_SQL}
SELECT sample_id, row_number() OVER (ORDER BY sample_id) AS position FROM samples""")
def srt1(spark, sf):
    """Anchor ids in text order with their position, without one global sort."""
    ids = align.anchor_ids(t.samples(spark, sf))
    return number_rows(ids, ["sample_id"], "position")


@query("srt2_first_missing", """
SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 5""")
def srt2(spark, sf):
    docs = t.table(spark, sf, "documents").select("doc_id", "lang")
    return docs.join(t.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").orderBy("doc_id").limit(5)


# The mean value of a feature per tissue stands for the coefficients of per-tissue models.
TOP_SQL = """means AS (
  SELECT "Tissue", feature, dim, round(avg(value), 9) AS weight FROM cells WHERE value IS NOT NULL GROUP BY ALL)"""


@query("srt3_top_coefficients", f"""WITH {t.CELLS_SQL}, {TOP_SQL}
SELECT "Tissue", feature, round(weight, 6) + 0.0 AS weight, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY "Tissue" ORDER BY abs(weight) DESC, dim) AS rn FROM means) WHERE rn <= 5""")
def srt3(spark, sf):
    from ..operators.linear import top_coefficients

    cells = t.cells(spark, sf, with_meta=True).filter("value is not null")
    means = cells.groupBy("Tissue", "feature", F.col("dim").alias("idx")).agg(
        F.round(F.avg(F.col("value").cast("double")), 9).alias("weight"))
    top = top_coefficients(means, ["Tissue"], 5)
    return top.select("Tissue", "feature", rounded("weight").alias("weight"), "rn")


TRIALS_SQL = f"""{t.PARTS_SQL}, report AS (
  SELECT CAST(substr(p_brand, 7) AS INTEGER) AS trial, project_id, avg(abs(y - yhat)) AS mae FROM parts GROUP BY 1, 2)"""


def _trials(spark, sf):
    trial = F.substr("p_brand", F.lit(7)).cast("int")
    error = F.avg(F.abs(F.col("y") - F.col("yhat")))
    per_fold = t.parts(spark, sf).groupBy(trial.alias("trial"), "project_id").agg(error.alias("mae"))
    return trial_scores(per_fold.withColumns({"model_key": F.lit("Global"), "alpha": F.col("trial") / 10}), ["alpha"])


@query("srt4_best_trial", f"""WITH {TRIALS_SQL}
SELECT trial, round(score, 9) AS score, alpha FROM (
  SELECT trial, round(avg(mae), 9) AS score, trial / 10 AS alpha FROM report GROUP BY trial) ORDER BY score, trial LIMIT 1""")
def srt4(spark, sf):
    """Brands as trials, part types as folds."""
    return best_trial(_trials(spark, sf).withColumn("score", F.round("score", 9)), ["alpha"])


@query("set1_union_features", f"""WITH {t.CELLS_SQL}
SELECT DISTINCT modality, feature FROM cells WHERE value IS NOT NULL""")
def set1(spark, sf):
    parts = [t.cells(spark, sf).filter((F.col("modality") == m) & F.col("value").isNotNull()).select("modality", "feature").distinct()
             for m in [*MODALITIES, "pc"]]
    return align.stack_modalities(parts)


@query("set2_shared_ids", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def set2(spark, sf):
    return t.table(spark, sf, "documents").select("doc_id").intersect(t.table(spark, sf, "labels").select("doc_id"))


@query("set3_difference", "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def set3(spark, sf):
    """Orders without lines."""
    lines = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.table(spark, sf, "orders").select("o_orderkey").join(lines, "o_orderkey", "left_anti")


@query("set4_fold_union", f"""WITH {t.PARTS_SQL}, folded AS (SELECT *, p_partkey % 5 AS fold FROM parts), total AS (
  SELECT sum(y) AS s, count(*) AS n FROM folded), per_fold AS (
  SELECT fold, sum(y) AS s, count(*) AS n FROM folded GROUP BY fold)
SELECT p_partkey, round((t.s - f.s) / (t.n - f.n), 6) + 0.0 AS oof
FROM folded JOIN per_fold f USING (fold), total t""")
def set4(spark, sf):
    """Each row takes the prediction (a mean) of the model that did not see its fold: one join, no loop."""
    from ..operators.stats import all_but_each_fold

    parts = t.parts(spark, sf).withColumn("fold", F.col("p_partkey") % 5)
    sums = parts.groupBy("fold").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    models = all_but_each_fold(sums, [], ["s", "n"]).select("fold", (F.col("s") / F.col("n")).alias("oof"))
    return parts.join(settle(models), "fold").select("p_partkey", rounded("oof").alias("oof"))


@query("fn1_age_transform", """
SELECT p_partkey, round(CASE WHEN p_size <= 20 THEN ln(p_size + 1) - ln(21) ELSE (p_size - 20) / 21 END, 6) + 0.0 AS y FROM part""")
def fn1(spark, sf):
    return t.table(spark, sf, "part").select("p_partkey", rounded(scalar.age_to_scale(F.col("p_size"))).alias("y"))


@query("fn2_age_inverse", """
SELECT c_custkey, round(CASE WHEN c_acctbal < 0 THEN 21 * exp(c_acctbal / 1000) - 1 ELSE c_acctbal / 1000 * 21 + 20 END, 6) + 0.0 AS age
FROM customer""")
def fn2(spark, sf):
    y = F.col("c_acctbal") / 1000
    return t.table(spark, sf, "customer").select("c_custkey", rounded(scalar.scale_to_age(y)).alias("age"))


@query("fn4_residual", f"""WITH {t.PARTS_SQL}
SELECT p_partkey, y - yhat AS target_residual, yhat + (y - yhat) / 2 AS fused_age FROM parts""")
def fn4(spark, sf):
    df = t.parts(spark, sf).withColumn("target_residual", residual(F.col("y"), F.col("yhat")))
    return df.select("p_partkey", "target_residual", fused_age(F.col("yhat"), F.col("target_residual") / 2).alias("fused_age"))


@query("fn5_fill_missing", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 0.0 ELSE coalesce(value, 0) END AS value FROM events""")
def fn5(spark, sf):
    """Errors become NaN, NaN and NULL become 0."""
    nan = F.when(F.col("event_type") == "error", float("nan")).otherwise(F.col("value"))
    return t.table(spark, sf, "events").select("event_id", scalar.fill_missing(nan).alias("value"))


@query("fn6_arithmetic", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(greatest(l_quantity, 10), 40) AS clipped,
       CAST(trunc(l_extendedprice) AS INTEGER) AS whole, round(sqrt(abs(l_tax - 0.04)), 6) + 0.0 AS root FROM lineitem""")
def fn6(spark, sf):
    return t.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", scalar.clip(F.col("l_quantity"), 10.0, 40.0).alias("clipped"),
        F.col("l_extendedprice").cast("int").alias("whole"), rounded(F.sqrt(F.abs(F.col("l_tax") - 0.04))).alias("root"))


@query("fn7_round4", "SELECT event_id, round(value / 7, 4) + 0.0 AS value FROM events")
def fn7(spark, sf):
    return t.table(spark, sf, "events").select("event_id", rounded(F.col("value") / 7, 4).alias("value"))


@query("fn8_strings", """
SELECT p_partkey, starts_with(p_name, 'small') AS small, ends_with(p_name, 'widget') AS widget,
       replace('Tissue_' || p_type, 'Tissue_', '') AS tissue, lower(p_brand) AS brand,
       'cg' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS site FROM part""")
def fn8(spark, sf):
    return t.table(spark, sf, "part").select(
        "p_partkey", F.startswith("p_name", F.lit("small")).alias("small"), F.endswith("p_name", F.lit("widget")).alias("widget"),
        scalar.strip_prefix(F.concat(F.lit("Tissue_"), "p_type"), "Tissue_").alias("tissue"),
        F.lower("p_brand").alias("brand"), scalar.site_name(F.col("p_partkey")).alias("site"))


@query("fn9_json", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
       json_object('event_type', event_type, 'k', CAST(json_extract(props, '$.k') AS INTEGER)) AS packed FROM events""")
def fn9(spark, sf):
    k = F.from_json("props", "k int")["k"]
    df = t.table(spark, sf, "events").select("event_id", "event_type", k.alias("k"))
    return df.select("event_id", "k", F.to_json(F.struct("event_type", "k")).alias("packed"))


@query("fn10_standardize", """
WITH s AS (SELECT l_returnflag, avg(l_quantity) AS m, stddev_pop(l_quantity) AS d FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity - m) / CASE WHEN d = 0 THEN 1 ELSE d END, 6) + 0.0 AS z
FROM lineitem JOIN s USING (l_returnflag)""")
def fn10(spark, sf):
    lines = t.table(spark, sf, "lineitem")
    stats = settle(lines.groupBy("l_returnflag").agg(F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("d")))
    z = scalar.standardize(F.col("l_quantity"), F.col("m"), F.col("d"))
    return lines.join(stats, "l_returnflag").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rounded(z).alias("z"))


@query("art1_settings", f"""WITH {t.SAMPLES_SQL}
SELECT count(*) AS n_samples, count(DISTINCT "Tissue") AS n_tissues FROM samples""")
def art1_settings(spark, sf):
    """Settings go through the store as JSON."""
    store = ModelStore(spark, scratch_path(spark, "store"))
    row = t.samples(spark, sf).agg(F.count("*").alias("n_samples"), F.count_distinct("Tissue").alias("n_tissues")).first()
    store.save("settings", row.asDict())
    back = store.load_settings("settings")
    return spark.createDataFrame([(back["n_samples"], back["n_tissues"])], "n_samples long, n_tissues long")
