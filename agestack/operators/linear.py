"""Ridge and elastic net, fitted per key from Gram statistics; Spark ML for very many features.

A model table has one row per key: ``intercept`` and ``weights`` (array in feature order).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import settle

#: Elastic-net jobs that one task solves, each from the weights of the one before.
PATH_JOBS = 5


def _centred(total: np.ndarray, use: np.ndarray | None = None):
    """n, means and centred cross products from Z'Z, for the feature positions in ``use``."""
    p = len(total) - 2
    use = np.arange(p) if use is None else use
    n = total[0, 0]
    mx, my = total[0, 1 + use] / n, total[0, -1] / n
    sxx = total[np.ix_(1 + use, 1 + use)] - n * np.outer(mx, mx)
    sxy = total[1 + use, -1] - n * mx * my
    return n, mx, my, sxx, sxy


def unit_scales(total: np.ndarray, use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Means and standard deviations (of the whole set, 1 for constant features) from Z'Z."""
    p = len(total) - 2
    at = 1 + (np.arange(p) if use is None else use)
    mean, square = total[0, at] / total[0, 0], total[at, at] / total[0, 0]
    spread = square - mean * mean
    # a difference that rounding alone can make is none
    return mean, np.where(spread > 1e-12 * np.maximum(square, 1e-300), np.sqrt(np.maximum(spread, 0.0)), 1.0)


def ridge_weights(total: np.ndarray, alpha: float, use: np.ndarray | None = None,
                  standardize: bool = False) -> tuple[float, np.ndarray]:
    """Minimise ||y - Xw - b||^2 + alpha ||w||^2; with ``standardize`` the penalty is on the weights of features of unit
    scale, and the weights returned are those of the features as they are."""
    _, mx, my, sxx, sxy = _centred(total, use)
    scale = unit_scales(total, use)[1] if standardize else np.ones(len(sxy))
    w = np.linalg.lstsq(sxx / np.outer(scale, scale) + alpha * np.eye(len(sxy)), sxy / scale, rcond=None)[0] / scale
    return float(my - mx @ w), w


def _descend(quad: np.ndarray, grad: np.ndarray, w: np.ndarray, l1: float, l2: float, max_iter: int, tol: float) -> None:
    """Cyclic descent from ``w``, whose gradient is ``grad``; both are changed in place."""
    for _ in range(max_iter):
        step = 0.0
        for j in range(len(w)):
            curve = quad[j, j] + l2
            if curve <= 1e-15:
                continue
            pull = grad[j] + quad[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - l1, 0.0) / curve
            if new != w[j]:
                grad -= quad[j] * (new - w[j])
                step = max(step, abs(new - w[j]))
                w[j] = new
        if step <= tol * max(1.0, np.abs(w).max(initial=0.0)):
            break


def elastic_net_weights(total: np.ndarray, alpha: float, l1_ratio: float, max_iter: int = 2000, tol: float = 1e-9,
                        use: np.ndarray | None = None, standardize: bool = False) -> tuple[float, np.ndarray]:
    """Minimise ||y - Xw - b||^2 / 2n + alpha l1 |w| + alpha (1 - l1) ||w||^2 / 2 by cyclic descent.

    ``standardize``: as for ``ridge_weights``; a congruence of the statistics, no second look at the rows.
    """
    n, mx, my, sxx, sxy = _centred(total, use)
    scale = unit_scales(total, use)[1] if standardize else np.ones(len(sxy))
    quad, lin = sxx / n / np.outer(scale, scale), sxy / n / scale
    w, grad = np.zeros(len(lin)), lin.copy()
    _descend(quad, grad, w, alpha * l1_ratio, alpha * (1.0 - l1_ratio), max_iter, tol)
    w = w / scale
    return float(my - mx @ w), w


def elastic_net_path(total: np.ndarray, jobs: list[dict], max_iter: int = 2000, tol: float = 1e-9, use: np.ndarray | None = None,
                     standardize: bool = False) -> list[tuple[float, np.ndarray]]:
    """``elastic_net_weights`` of many jobs (``alpha, l1``) on one set of statistics, in the order of ``jobs``.

    Jobs are solved by falling L1 penalty, each from the weights of the one before.  The strong rule picks the features
    that may get weight; features it left out whose gradient breaks the optimality condition join, until none does.
    """
    n, mx, my, sxx, sxy = _centred(total, use)
    scale = unit_scales(total, use)[1] if standardize else np.ones(len(sxy))
    quad, lin = sxx / n / np.outer(scale, scale), sxy / n / scale
    w, grad, before = np.zeros(len(lin)), lin.copy(), np.abs(lin).max(initial=0.0)
    out: list = [None] * len(jobs)
    for at in sorted(range(len(jobs)), key=lambda i: -jobs[i]["alpha"] * jobs[i]["l1"]):
        alpha, ratio = jobs[at]["alpha"], jobs[at]["l1"]
        l1, l2 = alpha * ratio, alpha * (1.0 - ratio)
        chosen = (np.abs(grad) >= 2 * l1 - before) | (w != 0)
        while True:
            some = np.flatnonzero(chosen)
            part, slope = w[some], grad[some]
            _descend(quad[np.ix_(some, some)], slope, part, l1, l2, max_iter, tol)
            w[some] = part
            grad = lin - quad[:, some] @ part
            broken = ~chosen & (np.abs(grad) > l1 * (1 + 1e-9) + 1e-12)
            if not broken.any():
                break
            chosen |= broken
        before = l1
        weights = w / scale
        out[at] = (float(my - mx @ weights), weights)
    return out


def _square(pdf: pd.DataFrame, m: int) -> np.ndarray:
    total = np.zeros((m, m))
    i, j, v = pdf["i"].to_numpy(), pdf["j"].to_numpy(), pdf["v"].to_numpy()
    total[i, j] = v
    total[j, i] = v
    return total


def solve_per_key(stats: DataFrame, keys: list[str], p: int, candidates: list[dict],
                  solve: Callable[[np.ndarray, dict], tuple[float, np.ndarray]]) -> DataFrame:
    """Fit every candidate on the statistics of every key.  A group is one (p+2)^2 triangle, never rows.

    A candidate that names a value for one of the keys is fitted for that value only.
    """
    fields = [T.StructField(k, stats.schema[k].dataType) for k in keys]
    schema = T.StructType(fields + [
        T.StructField("trial", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("intercept", T.DoubleType()), T.StructField("weights", T.ArrayType(T.DoubleType())),
    ])
    grouped = stats if keys else stats.withColumn("__all", F.lit(1))
    group_keys = keys or ["__all"]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        total = _square(pdf, p + 2)
        key = {k: pdf[k].iloc[0] for k in keys}
        rows = []
        for c in candidates:
            if total[0, 0] < 1 or any(k in c and c[k] != key[k] for k in keys):
                continue
            intercept, w = solve(total, c)
            rows.append({**key, "trial": int(c.get("trial", 0)), "n": int(total[0, 0]), "intercept": intercept,
                         "weights": [float(x) for x in w]})
        return pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    return grouped.groupBy(*group_keys).applyInPandas(fit, schema)


def fit_paths(stats: DataFrame, keys: list[str], p: int, jobs: list[dict], max_iter: int = 2000, standardize: bool = False,
              path_jobs: int = PATH_JOBS) -> DataFrame:
    """``keys, trial, n, intercept, weights`` of elastic-net jobs (``trial, alpha, l1, use`` and a value per key).

    Jobs of one key and feature set are dealt by falling L1 penalty to paths of at most ``path_jobs``, so that every path
    goes from large to small penalties.  Every path is a task of its own: a key's triangle is packed once into one value
    and sent to the tasks of its paths.  Jobs whose key has no rows give none.
    """
    spark = stats.sparkSession
    sets: dict[tuple, list[dict]] = {}
    for job in jobs:
        positions = None if job["use"] is None else tuple(job["use"])
        sets.setdefault((*(job[k] for k in keys), positions), []).append(job)
    paths: list[list[dict]] = []
    for some in sets.values():
        ordered, n_paths = sorted(some, key=lambda c: -c["alpha"] * c["l1"]), -(-len(some) // path_jobs)
        paths += [ordered[i::n_paths] for i in range(n_paths)]
    key_fields = [T.StructField(k, stats.schema[k].dataType) for k in keys]
    out = T.StructType(key_fields + [
        T.StructField("trial", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("intercept", T.DoubleType()), T.StructField("weights", T.ArrayType(T.DoubleType())),
    ])
    if not paths:
        return spark.createDataFrame([], out)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        total = _square(pdf, p + 2)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "triangle": total[np.triu_indices(p + 2)].tobytes()}])

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for row in pdf.to_dict("records"):
                total, some = np.zeros((p + 2, p + 2)), paths[row["path"]]
                total[np.triu_indices(p + 2)] = np.frombuffer(row["triangle"])
                total = np.triu(total) + np.triu(total, 1).T
                if total[0, 0] < 1:
                    continue
                use = None if some[0]["use"] is None else np.asarray(some[0]["use"], dtype=int)
                for job, (intercept, w) in zip(some, elastic_net_path(total, some, max_iter, use=use, standardize=standardize)):
                    rows.append({**{k: row[k] for k in keys}, "trial": int(job["trial"]), "n": int(total[0, 0]),
                                 "intercept": intercept, "weights": w.tolist()})
            yield pd.DataFrame(rows, columns=out.names)

    listed = pa.Table.from_pylist([{"path": i, **{k: path[0][k] for k in keys}} for i, path in enumerate(paths)],
                                  schema=to_arrow_schema(T.StructType([T.StructField("path", T.IntegerType()), *key_fields])))
    wanted = spark.createDataFrame(listed)  # an Arrow table, so Spark knows that it is small
    packed = settle(stats.join(wanted.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).applyInPandas(
        pack, T.StructType(key_fields + [T.StructField("triangle", T.BinaryType())])), "triangles")
    return packed.join(wanted, keys).repartitionById(len(paths), F.col("path")).mapInPandas(solve, out)


def spread(w: np.ndarray, p: int, use: np.ndarray | None) -> np.ndarray:
    """Weights of a feature subset as a full-length vector."""
    if use is None:
        return w
    full = np.zeros(p)
    full[use] = w
    return full


def fit_ridge(stats: DataFrame, keys: list[str], p: int, alpha: float, use: list[int] | None = None,
              standardize: bool = False) -> DataFrame:
    positions = None if use is None else np.asarray(use, dtype=int)

    def solve(total: np.ndarray, c: dict) -> tuple[float, np.ndarray]:
        base, w = ridge_weights(total, c["alpha"], positions, standardize)
        return base, spread(w, p, positions)

    return solve_per_key(stats, keys, p, [{"alpha": alpha}], solve)


def fit_elastic_net(stats: DataFrame, keys: list[str], p: int, alpha: float, l1_ratio: float,
                    max_iter: int = 2000, standardize: bool = False) -> DataFrame:
    return solve_per_key(stats, keys, p, [{"alpha": alpha, "l1": l1_ratio}],
                         lambda t, c: elastic_net_weights(t, c["alpha"], c["l1"], max_iter, standardize=standardize))


def scale_table(stats: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, idx, mean, scale`` of every feature from Gram triangles: all that scoring at unit scale needs, without the rows."""
    n = F.max(F.when((F.col("i") == 0) & (F.col("j") == 0), F.col("v")))
    last = F.max("j")
    total = stats.groupBy(*keys).agg(n.alias("n"), last.alias("last"))
    sums = stats.filter("i = 0 and j > 0").select(*keys, F.col("j").alias("at"), F.col("v").alias("s"))
    squares = stats.filter("i = j and i > 0").select(*keys, F.col("i").alias("at"), F.col("v").alias("q"))
    same = [*keys, "at"]
    each = sums.join(squares, same)
    each = (each.join(total, keys) if keys else each.crossJoin(F.broadcast(total))).filter("at < last")
    mean, square = F.col("s") / F.col("n"), F.col("q") / F.col("n")
    spread = square - mean * mean
    scale = F.when(spread > 1e-12 * square, F.sqrt(spread)).otherwise(1.0)
    return each.select(*keys, (F.col("at") - 1).alias("idx"), mean.alias("mean"), scale.alias("scale"))


def fit_tissue_family(per_tissue: DataFrame, p: int, alpha: float, min_samples: int = 50, key: str = "Tissue",
                      keys: list[str] | None = None, use: list[int] | None = None) -> DataFrame:
    """One ridge per tissue with enough samples plus ``Global``, whose statistics are the sum of all."""
    keys = keys or []
    counts = per_tissue.filter((F.col("i") == 0) & (F.col("j") == 0) & (F.col("v") >= min_samples))
    own = per_tissue.join(counts.select(*keys, key), [*keys, key], "left_semi")
    own = own.select(*keys, F.col(key).alias("model_key"), "i", "j", "v")
    pooled = per_tissue.groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))
    pooled = pooled.select(*keys, F.lit("Global").alias("model_key"), "i", "j", "v")
    return fit_ridge(own.unionByName(pooled), [*keys, "model_key"], p, alpha, use)


def fit_simple_ridge(stats: DataFrame, alpha: float) -> DataFrame:
    """Ridge with one feature in closed form, from the sums of ``simple_stats``."""
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    slope = (F.col("sxy") - sx * sy / n) / (F.col("sxx") - sx * sx / n + F.lit(float(alpha)))
    return stats.withColumn("weight", slope).withColumn("intercept", (sy - F.col("weight") * sx) / n)


def fit_simple_elastic_net(stats: DataFrame, alpha: float, l1_ratio: float) -> DataFrame:
    """Elastic net with one feature: the soft threshold."""
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    pull, curve = (F.col("sxy") - sx * sy / n) / n, (F.col("sxx") - sx * sx / n) / n
    shrunk = F.signum(pull) * F.greatest(F.abs(pull) - alpha * l1_ratio, F.lit(0.0))
    return stats.withColumn("weight", shrunk / (curve + alpha * (1.0 - l1_ratio))).withColumn(
        "intercept", (sy - F.col("weight") * sx) / n
    )


def fit_elastic_net_wide(df: DataFrame, y: str, alpha: float, l1_ratio: float, max_iter: int = 2000) -> DataFrame:
    """The same objective through Spark ML's gradient aggregation, for matrices too wide for a Gram.

    Spark divides its L2 term by the label's sample standard deviation, so that part is multiplied by it.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    rows = df.select(array_to_vector(F.col("values").cast("array<double>")).alias("features"),
                     F.col(y).cast("double").alias("label")).filter("label is not null")
    spread, n = rows.agg(F.stddev_samp("label"), F.count(F.lit(1))).first()
    l1, l2 = alpha * l1_ratio, alpha * (1.0 - l1_ratio) * (spread or 0.0)
    total = l1 + l2
    model = LinearRegression(
        solver="l-bfgs", standardization=False, regParam=total, elasticNetParam=l1 / total if total else 0.0,
        maxIter=max_iter, tol=1e-10,
    ).fit(rows)
    row = (0, int(n), float(model.intercept), [float(w) for w in model.coefficients])
    return df.sparkSession.createDataFrame([row], "trial int, n long, intercept double, weights array<double>")


def fit_ridge_wide(df: DataFrame, y: str, alpha: float) -> DataFrame:
    """Ridge for very many features: an elastic net without L1, its penalty divided by n."""
    n = df.filter(F.col(y).isNotNull()).count()
    return fit_elastic_net_wide(df, y, alpha / n, 0.0)


def coefficient_table(models: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """One row per key and feature."""
    from .align import feature_index

    long = models.select(*keys, F.posexplode("weights").alias("idx", "weight"))
    return long.join(feature_index(models.sparkSession, features), "idx").select(*keys, "idx", "weight", "feature")


def active(coefficients: DataFrame, cut: float = 1e-12) -> DataFrame:
    return coefficients.filter(F.abs("weight") > cut)


def top_coefficients(coefficients: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k strongest coefficients of every model (absolute weight, ties by position)."""
    strongest = W.partitionBy(*keys).orderBy(F.abs("weight").desc(), F.col("idx"))
    return coefficients.withColumn("rn", F.row_number().over(strongest).cast("long")).filter(F.col("rn") <= k)
