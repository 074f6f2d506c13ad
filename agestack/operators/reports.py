"""Reports of the training jobs: errors by every grouping, metrics per model, importance of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.metrics import regression_metrics
from ..session import settle
from .linear import active
from .ranking import strength_rank

GROUPS = ["fold", "project_id", "Tissue"]


def error_cube(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, level, fold, project_id, Tissue, mae, n`` from error sums (``abs_error, n``) per fold, project and tissue.

    Levels: ``all`` rows of the keys together, and one row per ``fold``, ``project_id`` and ``Tissue``; the columns of the other
    groups are null.  A project or tissue that is null itself has a row of its own in its level.  All come from one aggregate.
    """
    sums = cells.groupingSets([[F.col(c) for c in keys], *[[F.col(c) for c in [*keys, g]] for g in GROUPS]], *keys, *GROUPS).agg(
        *[F.grouping(g).alias(f"__{g}") for g in GROUPS], F.sum("abs_error").alias("s"), F.sum("n").alias("n"))
    level = F.lit("all")
    for g in GROUPS:
        level = F.when(F.col(f"__{g}") == 0, g).otherwise(level)
    return sums.filter("n > 0").select(*keys, level.alias("level"), *GROUPS, (F.col("s") / F.col("n")).alias("mae"), "n")


def trial_report(cube: DataFrame, keys: list[str]) -> DataFrame:
    """One row per ``keys``: ``micro_mae`` over all rows, ``macro_mae`` as the mean over projects, ``tissue_mae`` as the mean over
    tissues, ``fold_mae`` as the mean over folds, ``worst_tissue`` with ``worst_mae``, and the numbers of rows, folds, projects
    and tissues.  Of tissues with the same error the smallest name is the worst; a null one comes before all names."""
    def of(level: str, value: str = "mae") -> Column:
        return F.when(F.col("level") == level, F.col(value))

    worst = F.min(F.when(F.col("level") == "Tissue", F.struct((-F.col("mae")).alias("neg"), F.col("Tissue").alias("t"))))
    return cube.groupBy(*keys).agg(
        F.max(of("all")).alias("micro_mae"), F.avg(of("project_id")).alias("macro_mae"), F.avg(of("Tissue")).alias("tissue_mae"),
        F.avg(of("fold")).alias("fold_mae"), F.max(of("all", "n")).alias("n"), F.count(of("fold")).alias("n_folds"),
        F.count(of("project_id")).alias("n_projects"), F.count(of("Tissue")).alias("n_tissues"), worst.alias("w"),
    ).withColumns({"worst_tissue": F.col("w.t"), "worst_mae": -F.col("w.neg")}).drop("w")


def performance(predictions: DataFrame, truth: Column, columns: dict[str, str]) -> DataFrame:
    """``model_key, n, MAE, R2, PearsonR, MedianAE, MacroMAE, n_projects`` of held-out predictions.

    ``columns`` maps a model key to its column of predictions, which are compared with ``truth``.  ``MacroMAE`` is the mean over
    projects.  Rows without a truth or a prediction do not count; a model without any has no row.
    """
    cells = F.array(*[F.struct(F.lit(k).alias("model_key"), F.col(f"`{c}`").cast("double").alias("yhat")) for k, c in columns.items()])
    long = predictions.select("project_id", truth.cast("double").alias("y"), F.explode(cells).alias("c")).select(
        "project_id", "y", "c.model_key", "c.yhat").filter("y is not null and yhat is not null")
    per_project = long.groupBy("model_key", "project_id").agg(F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("mae"))
    macro = per_project.groupBy("model_key").agg(F.round(F.avg("mae"), 4).alias("MacroMAE"), F.count(F.lit(1)).alias("n_projects"))
    return regression_metrics(long, ["model_key"]).join(settle(macro, "macro"), "model_key")


def importance(coefficients: DataFrame, spread: DataFrame) -> DataFrame:
    """``model_key, idx, feature, weight, importance, share, rank`` of every feature with a weight, strongest first.

    Importance is the absolute weight times the spread (``idx, sd``) of the feature over the training rows: the change of the
    prediction when the feature moves by one standard deviation.  ``share`` is its part of the model's sum.  Ties are ranked by
    position.  A model of zeros alone has no rows, and so have features that do not vary.
    """
    strong = active(coefficients).join(settle(spread, "spread"), "idx").withColumn("importance", F.abs("weight") * F.col("sd"))
    strong = settle(strong.filter("importance > 0").drop("sd"), "importance")
    total = settle(strong.groupBy("model_key").agg(F.sum("importance").alias("__sum"), F.max("importance").alias("__max")), "importance-sums")
    each = strong.join(total, "model_key").withColumn("share", F.col("importance") / F.col("__sum"))
    each = each.withColumn("__strength", F.col("importance") / F.col("__max"))
    return strength_rank(each, ["model_key"], "__strength", "idx", "rank").select(
        "model_key", "idx", "feature", "weight", "importance", "share", F.col("rank").cast("long").alias("rank"))


def spread_of(moments: DataFrame) -> DataFrame:
    """``idx, sd`` from the moments of the features."""
    variance = F.col("sxx") / F.col("n") - (F.col("sx") / F.col("n")) * (F.col("sx") / F.col("n"))
    return moments.select("idx", F.sqrt(F.greatest(variance, F.lit(0.0))).alias("sd"))
