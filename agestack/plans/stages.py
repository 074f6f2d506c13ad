"""The three training stages and end-to-end scoring, composed from the operators.

Inputs are a narrow sample table (``sample_id, project_id, Tissue, Age, Sex, Is_Healthy``) and a packed
matrix (``sample_id, values``) with its feature names.  Each stage writes its training table once, and
hands the next one tables in a ``ModelStore``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import AGE_TARGET, PLAIN_TARGET, Target
from ..operators.align import (
    FIRST_SCORING, FIRST_TRAINING, expand_over_modalities, join_context, join_stages,
    order_output, pack_columns, pc_names, pick_features,
)
from ..operators.arrowhead import fit_arrowhead, with_offsets
from ..operators.contract import require_unique, require_width
from ..operators.folds import balanced_folds, healthy_filter, with_folds
from ..operators.impute import fold_fills, impute_packed, packed_fills
from ..operators.linear import fit_tissue_family, scale_table
from ..operators.normalise import expert_columns, resolve_metadata, resolve_stage1_prediction
from ..operators.reports import error_cube, importance, performance, spread_of, trial_report
from ..operators.score import (
    GLOBAL, few_numbers, fused_age, model_arrays, residual, score_many, score_packed, score_with_fallback,
)
from ..operators.search import (
    ELASTIC_NET_SPACE, PARAMS, best_params, fit_jobs, jobs_for, random_candidates, sampled_fold_stats, ridge_cells, scales_of, search_with_cells,
    fold_errors, training_triangles,
)
from ..operators.selection import assign_features, moments_correlation
from ..operators.stats import gram, moments
from ..schema import EXPERT_PREFIX, STAGE1_PRED, TISSUE_PREFIX
from ..session import local_table, settle
from ..sources.store import ModelStore

#: Trials of a search whose candidates are not given.
N_TRIALS = 50


def drawn(spark, candidates: list[dict] | None, n_trials: int, space: dict | None, seed: int) -> list[dict]:
    """The given candidates, or ``n_trials`` drawn from ``space`` (by default the elastic-net ranges)."""
    if candidates is not None:
        return candidates
    return [r.asDict() for r in random_candidates(spark, n_trials, space or ELASTIC_NET_SPACE, seed).orderBy("trial").collect()]


def require_inputs(samples: DataFrame | None, packed: DataFrame, p: int) -> None:
    """Refuse repeated ids, which joins would multiply, and packed rows of another width than the model's."""
    if samples is not None:
        require_unique(samples)
    require_unique(packed)
    require_width(packed, p)


def training_table(store: ModelStore, samples: DataFrame, packed: DataFrame, features: list[str], n_splits: int,
                   seed: int, healthy_only: bool = True, make_folds: Callable = balanced_folds) -> DataFrame:
    """Samples with a known age, their folds, target and packed features, written once to the store.

    Samples without features or without an age cannot be trained on and are left out.
    """
    require_inputs(samples, packed, len(features))
    meta = healthy_filter(samples, healthy_only).fillna("Unknown", ["project_id", "Tissue"])
    meta = meta.withColumn("y", AGE_TARGET.forward(F.col("Age"))).filter("y is not null")
    folds = make_folds(meta.join(packed.select("sample_id"), "sample_id", "left_semi"), n_splits, seed)
    folded = with_folds(meta, folds)
    store.save("training", folded.join(packed, "sample_id"))
    return store.load("training")


def _fit_all(data: DataFrame, p: int, candidates: list[dict], fills: list[float], subsets: dict, target: Target,
             n_splits: int, min_cohorts: int, seed: int, max_iter: int, halving: bool, solver: str,
             standardize: bool = False, set_fills: np.ndarray | None = None) -> tuple[DataFrame, DataFrame, list[dict], list[dict]]:
    """Search, held-out models and final models of all model keys from one balanced sample.

    Returns the trial report, the errors behind it, the final models and the models per held-out fold.  With ``set_fills`` the gaps of ``data`` are
    filled already, each row's as its own held-out set's.
    """
    spark = data.sparkSession
    caps = local_table(spark, [(c["trial"], c["min_cap"], c["max_cap"], float(c["mult"])) for c in candidates],
                                 "trial int, min_cap int, max_cap int, mult double")
    rows = data if set_fills is None else data.withColumn("values", F.col("gappy"))
    sampled = sampled_fold_stats(rows, p, "y", caps, n_splits, min_cohorts, seed, fills, solver, standardize, set_fills)
    report, cells = search_with_cells(data, candidates, sampled, target, max_iter, halving, subsets)
    jobs = jobs_for(sampled, best_params(report), subsets, list(range(n_splits + 1)))
    keys = list(subsets)
    fitted = [{**m, "model_key": keys[m["trial"]]} for m in fit_jobs(sampled, jobs, max_iter)]
    final = [m for m in fitted if m["held_out"] == n_splits]
    return report, cells, scales_of(sampled, final) if standardize and final else final, [m for m in fitted if m["held_out"] < n_splits]


def _save_search(store: ModelStore, stage: str, trials: DataFrame, cells: DataFrame, params: list[str]) -> None:
    """The report of all trials by fold, the errors by every grouping, and one line per trial with its parameters."""
    store.save(f"{stage}_trials", trials)
    keys = ["model_key", "trial"]
    store.save(f"{stage}_errors", error_cube(cells, keys))
    known = trials.select(*keys, *params).distinct()
    store.save(f"{stage}_report", known.join(trial_report(store.load(f"{stage}_errors"), keys), keys))


def _filled_by_fold(data: DataFrame, set_fills: np.ndarray | None) -> DataFrame:
    """``data`` with the gaps of each row filled by the medians of the rows outside its fold; ``gappy`` keeps them as they were."""
    return data if set_fills is None else impute_packed(data.withColumn("gappy", F.col("values")), set_fills, "fold")


def _stored_fills(store: ModelStore, n_splits: int, p: int) -> np.ndarray | None:
    """Fill values per held-out fold, if stage 1 was trained with them."""
    if not store.load_settings("stage1_settings")["fold_medians"]:
        return None
    out = np.zeros((n_splits + 1, p))
    rows = store.load("fold_medians").toArrow()
    out[rows.column("held_out").to_numpy(), rows.column("idx").to_numpy()] = rows.column("fill").to_numpy()
    return out


def train_stage1(store: ModelStore, samples: DataFrame, packed: DataFrame, features: list[str],
                 hallmark_sites: DataFrame, candidates: list[dict] | None = None, n_splits: int = 5, seed: int = 42,
                 min_cohorts: int = 2, max_iter: int = 2000, halving: bool = False, orthogonal: bool = True,
                 healthy_only: bool = True, solver: str = "gram", n_trials: int = N_TRIALS, space: dict | None = None,
                 standardize: bool = False, fold_medians: bool = False, make_folds: Callable = balanced_folds) -> DataFrame:
    """Global elastic net on all features.  Saves models, fills, features, trials, the hallmark dictionary and
    the training table; returns the out-of-fold table.

    ``standardize``: penalties are on features of unit scale; their means and scales are stored with the weights.
    ``fold_medians``: held-out models and errors never see medians of their own fold; by default all training rows give the
    medians.  Stage 2 follows the choice of either made here, unless told otherwise for ``standardize``.
    ``make_folds``: ``balanced_folds`` deals projects by their main tissue, ``stratified_folds`` by all their tissues.
    """
    p = len(features)
    data = training_table(store, samples, packed, features, n_splits, seed, healthy_only, make_folds)
    set_fills = fold_fills(data, p, "fold", n_splits) if fold_medians else None
    fills = set_fills[n_splits].tolist() if fold_medians else packed_fills(data, p)
    plain, data = data, _filled_by_fold(data, set_fills)
    report, cells, models, fold_models = _fit_all(data, p, drawn(data.sparkSession, candidates, n_trials, space, seed), fills, {GLOBAL: None}, AGE_TARGET, n_splits,
                                       min_cohorts, seed, max_iter, halving, solver, standardize, set_fills)
    meta = ["sample_id", "Age", "project_id", "Tissue", "Sex", "Is_Healthy"]
    oof = score_many(data, fold_models, [GLOBAL], ["pred_age"], p, meta, ["fold"], ["held_out"], fills, AGE_TARGET)
    oof = oof.withColumnRenamed("Age", "age").select(
        "sample_id", "age", "pred_age", "project_id", "Tissue", "Sex", "Is_Healthy")

    spark = data.sparkSession
    index = local_table(spark, [(i, f, float(v)) for i, (f, v) in enumerate(zip(features, fills))],
                        "idx int, feature string, fill double")
    dictionary = expand_over_modalities(hallmark_sites, index)
    sums = settle(moments(plain, [], p, "y", fills), "moments")
    if orthogonal:
        r = moments_correlation(sums).join(index, "idx").select("feature", "r")
        dictionary = assign_features(dictionary, r).select("hallmark", F.col("rank").alias("pos"), "feature")
    store.save("features", index)
    store.save("stage1_settings", {"standardize": standardize, "fold_medians": fold_medians})
    if set_fills is not None:
        held_out, idx = (a.ravel().astype(np.int32) for a in np.indices(set_fills.shape))
        store.save("fold_medians", spark.createDataFrame(pa.table({"held_out": held_out, "idx": idx, "fill": set_fills.ravel()})))
    _save_search(store, "stage1", report, cells, PARAMS)
    store.save("hallmark_features", dictionary)
    store.save_fitted("stage1", models, features)
    store.save("stage1_oof", oof)
    store.save("feature_spread", spread_of(sums))
    store.save("stage1_performance", performance(store.load("stage1_oof"), F.col("age"), {GLOBAL: "pred_age"}))
    store.save("stage1_importance", _importance(store, "stage1"))
    return store.load("stage1_oof")


def _importance(store: ModelStore, stage: str) -> DataFrame:
    """Weights that are stored at unit scale are taken back to the features as they are before their spread weighs them."""
    weights = store.load(f"{stage}_coefficients")
    scaling = store.load(f"{stage}_scaling").select("model_key", "idx", "scale")
    plain = weights.join(scaling, ["model_key", "idx"], "left").withColumn("weight", F.col("weight") / F.coalesce("scale", F.lit(1.0)))
    return importance(plain.drop("scale"), store.load("feature_spread"))


def _features(store: ModelStore) -> tuple[list[str], list[float]]:
    rows = store.load("features").orderBy("idx").collect()
    return [r["feature"] for r in rows], [r["fill"] for r in rows]


def hallmark_subsets(store: ModelStore, features: list[str]) -> dict[str, list[int]]:
    """Feature positions per hallmark, in dictionary order; hallmarks without features are skipped."""
    at = {f: i for i, f in enumerate(features)}
    subsets: dict[str, list[int]] = {}
    for r in store.load("hallmark_features").orderBy("hallmark", "pos").collect():
        if r["feature"] in at:
            subsets.setdefault(r["hallmark"], []).append(at[r["feature"]])
    return subsets


def train_stage2(store: ModelStore, candidates: list[dict] | None = None, n_splits: int = 5, seed: int = 42,
                 min_cohorts: int = 2, max_iter: int = 2000, halving: bool = False, target: str = "age",
                 solver: str = "gram", n_trials: int = N_TRIALS, space: dict | None = None,
                 standardize: bool | None = None) -> DataFrame:
    """One expert per hallmark.  All experts share one pass for statistics and one for scoring.

    ``target='age'`` fits the transformed age; ``'residual'`` fits age minus the stage-1 prediction.
    """
    features, fills = _features(store)
    data, oof1 = store.load("training"), store.load("stage1_oof")
    subsets = hallmark_subsets(store, features)
    inverse = AGE_TARGET
    if target == "residual":
        pred = oof1.select("sample_id", "pred_age")
        data = settle(data.join(pred, "sample_id").withColumn("y", residual(F.col("Age"), F.col("pred_age"))).drop("pred_age"))
        inverse = PLAIN_TARGET
    set_fills = _stored_fills(store, n_splits, len(features))
    data = _filled_by_fold(data, set_fills)
    if standardize is None:
        standardize = store.load_settings("stage1_settings")["standardize"]
    report, cells, models, fold_models = _fit_all(data, len(features), drawn(data.sparkSession, candidates, n_trials, space, seed), fills, subsets, inverse, n_splits,
                                       min_cohorts, seed, max_iter, halving, solver, standardize, set_fills)
    outs = [EXPERT_PREFIX + h for h in subsets]
    preds = score_many(data, fold_models, list(subsets), outs, len(features), ["sample_id"], ["fold"], ["held_out"], fills,
                       inverse)
    _save_search(store, "stage2", report, cells, PARAMS)
    store.save_fitted("stage2", models, features)
    store.save("stage2_settings", {"target": target, "hallmarks": list(subsets)})
    store.save("stage2_oof", oof1.join(preds, "sample_id"))
    truth = F.col("age") if target == "age" else residual(F.col("age"), F.col("pred_age"))
    store.save("stage2_performance", performance(store.load("stage2_oof"), truth, dict(zip(subsets, outs))))
    store.save("stage2_importance", _importance(store, "stage2"))
    return store.load("stage2_oof")


def apply_family(df: DataFrame, models: DataFrame, out: str, p: int, fold: str | None = None) -> DataFrame:
    """Score packed rows with the model of their tissue or the global one, per fold if ``fold`` is given; 0 without either.

    Few models are shipped to the tasks; a family too large for that is joined to the rows.
    """
    models = settle(models, "models")
    if few_numbers(models):
        model_keys = ["held_out", "model_key"] if fold else ["model_key"]
        arrays = model_arrays([r.asDict() for r in models.collect()], model_keys, p)
        scored = score_packed(df, arrays, [out], p, df.columns, [fold, "Tissue"] if fold else ["Tissue"],
                              lambda key: (*key[:-1], GLOBAL))
        return scored.fillna(0.0, [out])
    if fold is None:
        return score_with_fallback(df, models, "Tissue", out).drop("model_key")
    keyed = models.withColumn("model_key", F.concat_ws("|", "held_out", "model_key"))
    rows = df.withColumn("__key", F.concat_ws("|", fold, "Tissue"))
    other = F.concat_ws("|", F.col(fold), F.lit(GLOBAL))
    return score_with_fallback(rows, keyed, "__key", out, other).drop("__key", "model_key")


def train_stage3(store: ModelStore, stage1: DataFrame, stage2: DataFrame, context: DataFrame | None,
                 alpha: float = 1.0, candidates: list[dict] | None = None, min_samples: int = 50, n_splits: int = 5,
                 seed: int = 42, make_folds: Callable = balanced_folds) -> DataFrame:
    """Ridge fusion of the experts: target is age minus the stage-1 prediction, one model per large tissue plus
    a global one.  The table holds the in-sample correction and, as ``oof_correction``, the held-out one.

    With tissue indicators (a choice of the candidates) the global model has an offset per tissue, and a tissue too small for
    a model of its own is stored with the global one moved by its offset; ``stage3_offsets`` keeps the offsets themselves.

    The rows are read once for statistics; search, models and held-out models come from their sums.
    """
    for table in (stage1, stage2, *([] if context is None else [context])):
        require_unique(table)
    experts = expert_columns(stage2.columns)
    df = join_stages(resolve_stage1_prediction(stage1), stage2, experts)
    pcs: list[str] = []
    if context is not None:
        pcs = pc_names(context.columns)
        df = join_context(df, context, training=True)
    df = df.withColumn("target_residual", residual(F.col("age"), F.col(STAGE1_PRED)))
    df = df.fillna("Unknown", ["project_id", "Tissue"])
    everything = experts + pcs
    p = len(everything)
    df = settle(df, "stage3")
    folds = make_folds(df.select("project_id", "Tissue"), n_splits, seed)
    data = settle(with_folds(pack_columns(df, everything), folds), "stage3")

    per_fold_tissue = settle(gram(data, ["fold", "Tissue"], p, "target_residual"), "gram")

    def positions(use_pcs: bool) -> list[int]:
        return list(range(p if use_pcs else len(experts)))

    best = {"alpha": alpha, "use_pcs": bool(pcs), "use_tissue_dummies": False}
    if candidates:
        per_fold = per_fold_tissue.groupBy("fold", "i", "j").agg(F.sum("v").alias("v"))
        runs = [{"trial": c["trial"], "alpha": c["alpha"], "use": positions(c["use_pcs"]), "offsets": bool(c["use_tissue_dummies"])}
                for c in candidates]
        cells = settle(ridge_cells(data, per_fold, p, runs, "target_residual", n_splits, per_fold_tissue=per_fold_tissue), "cells")
        report = settle(fold_errors(cells), "trials")
        scores = report.groupBy("job").agg(F.avg("mae").alias("score"))
        winner = scores.orderBy("score", "job").first()["job"]
        best = next(c for c in candidates if c["trial"] == winner)
        store.save("stage3_trials", report.withColumnRenamed("job", "trial"))
        store.save("stage3_errors", error_cube(cells.withColumnRenamed("job", "trial"), ["trial"]))
        given = local_table(data.sparkSession, [(c["trial"], float(c["alpha"]), bool(c["use_pcs"]), bool(c["use_tissue_dummies"])) for c in candidates],
                            "trial int, alpha double, use_pcs boolean, use_tissue_dummies boolean")
        store.save("stage3_report", given.join(trial_report(store.load("stage3_errors"), ["trial"]), "trial"))
    use = positions(best["use_pcs"])

    def family(stats: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
        """One model per large tissue and the global one; with offsets, one for every tissue seen."""
        models = fit_tissue_family(stats, p, best["alpha"], min_samples, keys=keys, use=use)
        if not best["use_tissue_dummies"]:
            return models, None
        whole = fit_arrowhead(stats, keys, p, [{"alpha": best["alpha"], "use": use}])
        full = F.concat("weights", F.array_repeat(F.lit(0.0), p - len(use)))
        whole = settle(whole.withColumn("weights", full), "arrowhead")
        return with_offsets(models, whole, keys), whole

    models, whole = family(per_fold_tissue.groupBy("Tissue", "i", "j").agg(F.sum("v").alias("v")), [])
    models = settle(models, "models")
    fold_models, _ = family(training_triangles(per_fold_tissue, ["Tissue"], n_splits), ["held_out"])

    scored = apply_family(data, models, "stage3_correction", p)
    scored = apply_family(scored, fold_models, "oof_correction", p, "fold").drop("values")
    table = scored.withColumn("fused_age", fused_age(F.col(STAGE1_PRED), F.col("stage3_correction"))).withColumn(
        "oof_fused_age", fused_age(F.col(STAGE1_PRED), F.col("oof_correction")))
    chosen = [everything[i] for i in use]
    cut = pick_features(models, use, "weights")
    store.save_models("stage3", cut, chosen)
    store.save("stage3_settings", {**{k: best[k] for k in ("alpha", "use_pcs", "use_tissue_dummies")},
                                   "pcs": pcs if best["use_pcs"] else [], "features": chosen})
    spark = data.sparkSession
    offsets = local_table(spark, [], "feature string, weight double") if whole is None else whole.select(
        F.explode(F.arrays_zip("tissues", "offsets")).alias("t")).select(
        F.concat(F.lit(TISSUE_PREFIX), "t.tissues").alias("feature"), F.col("t.offsets").alias("weight"))
    store.save("stage3_offsets", offsets)
    store.save("stage3_oof", order_output(table, FIRST_TRAINING, rest=True))
    steps = {"stage1": STAGE1_PRED, "stage3": "oof_fused_age", "stage3_in_sample": "fused_age"}
    store.save("stage3_performance", performance(store.load("stage3_oof"), F.col("age"), steps))
    whole_sums = per_fold_tissue.groupBy("i", "j").agg(F.sum("v").alias("v")).withColumn("model_key", F.lit(GLOBAL))
    spread = scale_table(whole_sums, ["model_key"]).select("idx", F.col("scale").alias("sd"))
    place = local_table(spark, [(i, k) for k, i in enumerate(use)], "at int, k int")
    spread = spread.join(place, spread["idx"] == place["at"]).select(F.col("k").alias("idx"), "sd")
    store.save("stage3_importance", importance(store.load("stage3_coefficients"), spread))
    return store.load("stage3_oof")


def predict_stage1(store: ModelStore, samples: DataFrame, packed: DataFrame, batch_medians: bool = False) -> DataFrame:
    """Score aligned packed samples with the global model; gaps take the stored training medians, or with
    ``batch_medians`` those of the batch."""
    features, fills = _features(store)
    require_inputs(samples, packed, len(features))
    if batch_medians:
        fills = packed_fills(packed, len(features))
    joined = resolve_metadata(samples).join(packed, "sample_id")
    return score_many(joined, store.load_fitted("stage1"), [GLOBAL], [STAGE1_PRED], len(features),
                      ["sample_id", "Age", "Tissue", "project_id"], fills=fills, target=AGE_TARGET)


def predict_stage2(store: ModelStore, packed: DataFrame) -> DataFrame:
    """One column ``pred_resid_<hallmark>`` per expert."""
    features, fills = _features(store)
    require_inputs(None, packed, len(features))
    settings = store.load_settings("stage2_settings")
    hallmarks = settings["hallmarks"]
    target = AGE_TARGET if settings["target"] == "age" else PLAIN_TARGET
    return score_many(packed, store.load_fitted("stage2"), hallmarks, [EXPERT_PREFIX + h for h in hallmarks],
                      len(features), ["sample_id"], fills=fills, target=target)


def predict_stage3(store: ModelStore, df: DataFrame) -> DataFrame:
    """Correction by the model of the sample's tissue, the global one for unseen tissues."""
    df = resolve_stage1_prediction(df, strict=False)
    features = store.load_settings("stage3_settings")["features"]
    if "Tissue" not in df.columns:
        df = df.withColumn("Tissue", F.lit(GLOBAL))
    models = store.load_models("stage3")
    scored = apply_family(pack_columns(df, features), models, "pred_residual_stage3", len(features)).drop("values")
    scored = scored.fillna(0.0, ["pred_residual_stage3"])
    table = scored.withColumn("fused_age", fused_age(F.col(STAGE1_PRED), F.col("pred_residual_stage3")))
    return order_output(table, FIRST_SCORING, rest=False)


def predict_all(store: ModelStore, samples: DataFrame, packed: DataFrame, context: DataFrame | None) -> DataFrame:
    """All three stages as one lazy plan; stages 1 and 2 score each packed row in the same matrix product."""
    features, fills = _features(store)
    require_inputs(samples, packed, len(features))
    if context is not None:
        require_unique(context)
    settings = store.load_settings("stage2_settings")
    hallmarks = settings["hallmarks"]
    experts, p = [EXPERT_PREFIX + h for h in hallmarks], len(features)
    meta = ["sample_id", "Age", "Tissue", "project_id"]
    joined = resolve_metadata(samples).join(packed, "sample_id")
    first, second = store.load_fitted("stage1"), store.load_fitted("stage2")
    if settings["target"] == "age":
        scored = score_many(joined, first + second, [GLOBAL, *hallmarks], [STAGE1_PRED, *experts], p, meta, fills=fills,
                            target=AGE_TARGET)
    else:
        scored = score_many(joined, first, [GLOBAL], [STAGE1_PRED], p, [*meta, "values"], fills=fills, target=AGE_TARGET)
        scored = score_many(scored, second, hallmarks, experts, p, [*meta, STAGE1_PRED], fills=fills)
    if context is not None:
        scored = join_context(scored, context, training=False)
    return predict_stage3(store, scored)
