"""Ridge with an indicator per tissue, without a column per tissue.

The indicators' block of the normal equations is diagonal, so the whole matrix has the shape of an arrowhead.  Each tissue's
weight is taken out of the equations by its own counts and sums (the Schur complement), which leaves equations in the
other features only.  Work and memory grow with the number of tissues, not with its square or cube.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .linear import _square


def arrowhead_weights(total: np.ndarray, borders: np.ndarray, alpha: float,
                      use: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Minimise ||y - Xw - d[tissue] - b||^2 + alpha (||w||^2 + ||d||^2): intercept, weights, and an offset per tissue.

    ``total`` is Z'Z of all rows with Z = [1, x, y], ``borders`` has the sums of Z per tissue.  ``alpha`` must be above 0: without
    a penalty intercept and offsets are not determined.
    """
    if not alpha > 0:
        raise ValueError("tissue offsets need a penalty above 0")
    p = len(total) - 2
    at = np.concatenate([[0], 1 + (np.arange(p) if use is None else use), [p + 1]]).astype(int)
    total, borders = total[np.ix_(at, at)], borders[:, at]
    mean = total[0] / total[0, 0]
    shift = np.eye(len(at))
    shift[0, 1:] = -mean[1:]
    total, borders = shift.T @ total @ shift, borders @ shift
    weight = borders[:, 0] + alpha
    left = total - (borders / weight[:, None]).T @ borders
    penalty = np.full(len(at) - 1, alpha)
    penalty[0] = 0.0
    solution = np.linalg.solve(left[:-1, :-1] + np.diag(penalty), left[:-1, -1])
    offsets = (borders[:, -1] - borders[:, :-1] @ solution) / weight
    return float(solution[0] + mean[-1] - mean[1:-1] @ solution[1:]), solution[1:], offsets


def fit_arrowhead(per_tissue: DataFrame, keys: list[str], p: int, candidates: list[dict], tissue: str = "Tissue") -> DataFrame:
    """Every candidate (``trial, alpha, use``) on every key: ``keys, trial, n, intercept, weights, tissues, offsets``.

    ``per_tissue`` has Gram triangles per key and tissue (``i, j, v``).  They are added up by Spark; a group is one triangle and
    one row of sums per tissue.
    """
    pooled = per_tissue.groupBy(*keys, "i", "j").agg(F.sum("v").alias("v")).withColumn("__tissue", F.lit(None).cast("string"))
    sums = per_tissue.filter("i = 0").withColumnRenamed(tissue, "__tissue")
    names = [*keys, "__tissue", "i", "j", "v"]
    both = pooled.select(*names).unionByName(sums.select(*names))
    grouped = both if keys else both.withColumn("__all", F.lit(1))
    schema = T.StructType([T.StructField(k, per_tissue.schema[k].dataType) for k in keys] + [
        T.StructField("trial", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("intercept", T.DoubleType()),
        T.StructField("weights", T.ArrayType(T.DoubleType())), T.StructField("tissues", T.ArrayType(T.StringType())),
        T.StructField("offsets", T.ArrayType(T.DoubleType()))])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = pdf["__tissue"].isna()
        total = _square(pdf[whole], p + 2)
        rest = pdf[~whole].sort_values(["__tissue", "j"])
        tissues, row = np.unique(rest["__tissue"].to_numpy(dtype=str), return_inverse=True)
        borders = np.zeros((len(tissues), p + 2))
        borders[row, rest["j"].to_numpy()] = rest["v"].to_numpy()
        rows = []
        for c in candidates if total[0, 0] >= 1 else []:
            use = c.get("use")
            positions = None if use is None else np.asarray(use, dtype=int)
            base, w, offsets = arrowhead_weights(total, borders, c["alpha"], positions)
            rows.append({**{k: pdf[k].iloc[0] for k in keys}, "trial": int(c.get("trial", 0)), "n": int(total[0, 0]), "intercept": base,
                         "weights": w.tolist(), "tissues": tissues.tolist(), "offsets": offsets.tolist()})
        return pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    return grouped.groupBy(*(keys or ["__all"])).applyInPandas(fit, schema)


def with_offsets(family: DataFrame, whole: DataFrame, keys: list[str], other: str = "Global") -> DataFrame:
    """A family ``keys, model_key, n, intercept, weights`` whose model ``other`` is ``whole`` (of ``fit_arrowhead``); a tissue without
    a model of its own gets that one with its offset added."""
    own = family.filter(F.col("model_key") != other).select(*keys, "model_key", "n", "intercept", "weights")
    each = whole.select(*keys, "n", "intercept", "weights", F.explode(F.arrays_zip("tissues", "offsets")).alias("t"))
    moved = each.select(*keys, F.col("t.tissues").alias("model_key"), "n", (F.col("intercept") + F.col("t.offsets")).alias("intercept"), "weights")
    moved = moved.join(own.select(*keys, "model_key"), [*keys, "model_key"], "left_anti")
    base = whole.select(*keys, F.lit(other).alias("model_key"), "n", "intercept", "weights")
    names = [*keys, "model_key", "n", "intercept", "weights"]
    return own.unionByName(moved.select(*names)).unionByName(base.select(*names))
