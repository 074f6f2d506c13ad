"""Correlation of every feature with the target, ranks within hallmarks, winner takes all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from .ranking import strength_rank
from .stats import moments

GUARD = 1e-12


def _guarded_r(n: Column, num: Column, ssx: Column, ssy: Column) -> Column:
    product = F.greatest(ssx, F.lit(0.0)) * F.greatest(ssy, F.lit(0.0))
    return F.when(n < 2, 0.0).otherwise(F.coalesce(num / (F.sqrt(product) + GUARD), F.lit(0.0)))


def packed_correlation(df: DataFrame, p: int, y: str, fills: list[float] | None = None,
                       keys: list[str] | None = None) -> DataFrame:
    """Pearson r of every column of the packed matrix with ``y``."""
    return moments_correlation(moments(df, keys or [], p, y, fills), keys)


def moments_correlation(m: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The same from the moments of the columns."""
    n = F.col("n")
    num = F.col("sxy") - F.col("sx") * F.col("sy") / n
    ssx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    ssy = F.col("syy") - F.col("sy") * F.col("sy") / n
    return m.select(*(keys or []), "idx", n.cast("long").alias("n"), _guarded_r(n, num, ssx, ssy).alias("r"))


def cell_correlation(cells: DataFrame, y: str, key: str = "feature") -> DataFrame:
    """The same for long cells that already carry the target."""
    x, t = F.col("value").cast("double"), F.col(y).cast("double")
    both = cells.filter(x.isNotNull() & t.isNotNull())
    s = both.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop(x, t).alias("c"), F.var_pop(x).alias("vx"), F.var_pop(t).alias("vy")
    )
    n = F.col("n")
    return s.select(key, "n", _guarded_r(n, F.col("c") * n, F.col("vx") * n, F.col("vy") * n).alias("r"))


def rank_in_hallmark(hallmark_map: DataFrame, correlations: DataFrame, digits: int = 9) -> DataFrame:
    """0-based rank of each feature in its hallmark by |r|; ties keep dictionary order.

    |r| is rounded first so that sums added in another order cannot change a tie.
    """
    strength = F.round(F.abs("r"), digits)
    pairs = hallmark_map.join(settle(correlations.select("feature", strength.alias("abs_r")), "corr"), "feature")
    return strength_rank(pairs, ["hallmark"], "abs_r", "pos", "rank").withColumn("rank", F.col("rank") - 1)


def winners(ranked: DataFrame) -> DataFrame:
    """Each feature goes to the hallmark where it ranks best, then to the first name."""
    best = F.min(F.struct("rank", "hallmark", "abs_r"))
    return ranked.groupBy("feature").agg(best.alias("b")).select("feature", "b.hallmark", "b.rank", "b.abs_r")


def assign_features(hallmark_map: DataFrame, correlations: DataFrame) -> DataFrame:
    return winners(rank_in_hallmark(hallmark_map, correlations))


def features_by_hallmark(assigned: DataFrame) -> DataFrame:
    """The dictionary form: one sorted feature list per hallmark (bounded by the number of features)."""
    return assigned.groupBy("hallmark").agg(F.array_sort(F.collect_list("feature")).alias("features"))
