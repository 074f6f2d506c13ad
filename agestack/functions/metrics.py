"""Regression metrics for any grouping, each from one aggregate plus a median that scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ranking import MEDIAN_GROUP_ROWS, exact_median

FLAT = 1e-9


def mae(y: Column, yhat: Column) -> Column:
    return F.avg(F.abs(y - yhat))


def pearson(y: Column, yhat: Column) -> Column:
    """0 for fewer than two rows or a flat side (``corr`` would divide by zero)."""
    sy, sp = F.stddev_pop(y), F.stddev_pop(yhat)
    return F.when((F.count(y) > 1) & (sy > FLAT) & (sp > FLAT), F.covar_pop(y, yhat) / (sy * sp)).otherwise(0.0)


def r_squared(y: Column, yhat: Column) -> Column:
    sse, sst = F.sum((y - yhat) * (y - yhat)), F.var_pop(y) * F.count(y)
    return F.when(sst > 0, 1 - sse / sst).when(sse == 0, 1.0).otherwise(0.0)


def regression_metrics(df: DataFrame, keys: list[str], y: str = "y", yhat: str = "yhat", digits: int = 4,
                       group_rows: int = MEDIAN_GROUP_ROWS) -> DataFrame:
    """``MAE, R2, PearsonR, MedianAE`` and the row count per key, rounded."""
    true, guess = F.col(y).cast("double"), F.col(yhat).cast("double")
    pairs = df.select(*keys, true.alias("__y"), guess.alias("__p"), F.abs(true - guess).alias("__e"))
    pairs = pairs.filter("__e is not null")
    true, guess = F.col("__y"), F.col("__p")
    table = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(mae(true, guess), digits).alias("MAE"),
        F.round(r_squared(true, guess), digits).alias("R2"),
        F.round(pearson(true, guess), digits).alias("PearsonR"),
    )
    medians = exact_median(pairs, keys, "__e", "MedianAE", group_rows)
    if keys:
        table = table.join(medians, keys)
    else:
        table = table.withColumn("MedianAE", F.lit(medians.first()[0]).cast("double"))
    return table.withColumn("MedianAE", F.round("MedianAE", digits))


def fold_scores(errors: DataFrame, keys: list[str], fold: str = "fold", y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Mean of the fold MAEs: folds count alike whatever their size."""
    per_fold = errors.groupBy(*keys, fold).agg(mae(F.col(y), F.col(yhat)).alias("mae"))
    return per_fold.groupBy(*keys).agg(F.avg("mae").alias("score"), F.count(F.lit(1)).alias("n_folds"))


def micro_macro_mae(df: DataFrame, group: str = "project_id", y: str = "y", yhat: str = "yhat") -> DataFrame:
    """MAE over all rows and the mean of the group MAEs, from one pass over the rows."""
    error = F.abs(F.col(y) - F.col(yhat))
    per_group = df.groupBy(group).agg(F.sum(error).alias("s"), F.count(error).alias("n"))
    return per_group.agg(
        (F.sum("s") / F.sum("n")).alias("micro_mae"), F.avg(F.col("s") / F.col("n")).alias("macro_mae"),
        F.count(F.lit(1)).alias("n_groups"),
    )
