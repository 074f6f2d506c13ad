"""Scoring: a model is a table, a prediction is a join and a sum."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.scalar import PLAIN_TARGET, Target, dot, standardize
from ..session import settle
from .linear import active
from .stats import group_rows, matrix

GLOBAL = "Global"
MODEL_NUMBERS = 20_000_000
#: Rows that join one copy of a model.
SALT_ROWS = 100_000


def score_cells(cells: DataFrame, coefficients: DataFrame, intercept: float, ids: DataFrame) -> DataFrame:
    """Long route: join cells with the non-zero coefficients (``feature, mean, scale, weight``) and add up.

    Only active features are joined, and the sums are combined before the shuffle.  Samples without any
    active cell get the intercept.
    """
    weights = settle(active(coefficients).select("feature", "mean", "scale", "weight"), "weights")
    term = standardize(F.col("value").cast("double"), F.col("mean"), F.col("scale")) * F.col("weight")
    sums = cells.join(weights, "feature").groupBy("sample_id").agg(F.sum(term).alias("__s"))
    return ids.select("sample_id").join(sums, "sample_id", "left").select(
        "sample_id", (F.coalesce("__s", F.lit(0.0)) + F.lit(float(intercept))).alias("score")
    )


def score_cells_by_model(cells: DataFrame, coefficients: DataFrame, intercepts: DataFrame, key: str) -> DataFrame:
    """The same for many models at once (columns ``key, feature, weight``); every model sees every sample."""
    weights = settle(active(coefficients).select(key, "feature", "weight"), "weights")
    bases = settle(intercepts.select(key, "intercept"), "intercepts")
    sums = (
        cells.join(weights, "feature")
        .groupBy("sample_id", key).agg(F.sum(F.col("value").cast("double") * F.col("weight")).alias("__s"))
    )
    return sums.join(bases, key).select("sample_id", key, (F.col("__s") + F.col("intercept")).alias("score"))


def score_joined(df: DataFrame, models: DataFrame, on: list[str], out: str = "score") -> DataFrame:
    """Packed route inside the JVM: join the model of the row's key and take the inner product."""
    scored = df.join(settle(models.select(*on, "intercept", "weights"), "models"), on)
    return scored.withColumn(out, F.col("intercept") + dot(F.col("values"), F.col("weights"))).drop("intercept", "weights")


def model_key_with_fallback(df: DataFrame, keys: DataFrame, col: str = "Tissue", fallback: Column | None = None) -> DataFrame:
    """The row's own model where there is one, else ``Global`` (or the key in the column ``fallback``)."""
    known = settle(keys.select(F.col("model_key").alias("__own")).distinct(), "keys")
    joined = df.join(known, F.col(col) == F.col("__own"), "left")
    other = F.lit(GLOBAL) if fallback is None else fallback
    return joined.withColumn("model_key", F.coalesce("__own", other)).drop("__own")


def salted_models(keyed: DataFrame, models: DataFrame, rows_per_salt: int = SALT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Rows and models with a column ``__salt``, to be joined on it and ``model_key``.

    Rows of a model are counted first.  A model with more than ``rows_per_salt`` rows is copied, once per started
    ``rows_per_salt``, and its rows are dealt to the copies by a hash of their id (without ids: of the whole row).  Other
    models stay single, so copies number at most rows / ``rows_per_salt`` beyond the models.
    """
    salts = F.ceil(F.count(F.lit(1)) / rows_per_salt).cast("int").alias("__salts")
    hot = settle(keyed.groupBy("model_key").agg(salts).filter("__salts > 1"), "salts")
    copies = models.join(hot, "model_key", "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)))
    by = ["sample_id"] if "sample_id" in keyed.columns else keyed.columns
    salt = F.coalesce(F.pmod(F.xxhash64(*by), F.col("__salts")), F.lit(0)).cast("int")
    rows = keyed.join(hot, "model_key", "left").withColumn("__salt", salt)
    return rows.drop("__salts"), copies.drop("__salts")


def score_with_fallback(df: DataFrame, models: DataFrame, col: str = "Tissue", out: str = "correction",
                        fallback: Column | None = None, rows_per_salt: int = SALT_ROWS) -> DataFrame:
    """Score packed rows with the model of their tissue, the global model, or 0 without either.

    The rows of a hot tissue are spread over copies of its model.
    """
    models = settle(models.select("model_key", "intercept", "weights"), "models")
    rows, copies = salted_models(model_key_with_fallback(df, models, col, fallback), models, rows_per_salt)
    score = F.coalesce(F.col("intercept") + dot(F.col("values"), F.col("weights")), F.lit(0.0))
    return rows.join(copies, ["model_key", "__salt"], "left").withColumn(out, score).drop("intercept", "weights", "__salt")


def score_simple_with_fallback(df: DataFrame, models: DataFrame, x: str, col: str = "Tissue",
                               out: str = "correction") -> DataFrame:
    """The same for models of one feature (``model_key, intercept, weight``)."""
    models = settle(models.select("model_key", "intercept", "weight"), "models")
    keyed = model_key_with_fallback(df, models, col)
    score = F.coalesce(F.col("intercept") + F.col("weight") * F.col(x), F.lit(0.0))
    return keyed.join(models, "model_key", "left").withColumn(out, score).drop("intercept", "weight")


def few_numbers(models: DataFrame) -> bool:
    """Whether all weights may be shipped to every task."""
    return (models.agg(F.sum(F.size("weights"))).first()[0] or 0) <= MODEL_NUMBERS


def model_arrays(models: list[dict], keys: list[str], p: int, name: str | None = None,
                 outs: list[str] | None = None) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """Fitted models as key -> intercepts and weight matrix.

    A model may carry ``use``, the positions of its weights.  With ``name`` the models of a key that differ in
    that field become the matrix columns ``outs``.
    """
    found: dict[tuple, dict] = {}
    for m in models:
        found.setdefault(tuple(m[k] for k in keys), {})[m[name] if name else None] = m
    order = outs if name else [None]
    arrays = {}
    for key, ms in found.items():
        if any(o not in ms for o in order):
            raise ValueError(f"no model for some of {order} under {key}")
        weights = np.zeros((p, len(order)))
        for i, o in enumerate(order):
            use = ms[o].get("use")
            weights[slice(None) if use is None else np.asarray(use, dtype=int), i] = ms[o]["weights"]
        arrays[key] = (np.array([ms[o]["intercept"] for o in order]), weights)
    return arrays


def score_packed(df: DataFrame, models: dict[tuple, tuple], outs: list[str], p: int, keep: list[str],
                 keys: list[str] | None = None, fallback: Callable[[tuple], tuple] | None = None,
                 fills: list[float] | None = None, target: Target = PLAIN_TARGET) -> DataFrame:
    """Add the columns ``outs``, one per model, by one matrix product per Arrow batch and without a shuffle.

    ``models`` maps the row's key (``()`` without keys) to intercepts and a weight matrix.  A row whose key
    has no model takes the one ``fallback`` names for its key, else its scores stay NULL.
    """
    keys = keys or []
    vector = np.zeros(p) if fills is None else np.asarray(fills, dtype=np.float64)
    inverse: Callable = target.inverse_array
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(o, T.DoubleType()) for o in outs])
    columns = list(dict.fromkeys([*keep, *keys, "values"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("values"), p, vector)
            scores = np.full((batch.num_rows, len(outs)), np.nan)
            for key, rows in group_rows(batch, keys):
                model = models.get(key) or (models.get(fallback(key)) if fallback else None)
                if model is not None:
                    scores[rows] = inverse(x[rows] @ model[1] + model[0])
            made = [pa.array(scores[:, i], mask=np.isnan(scores[:, i])) for i in range(len(outs))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, keep + outs)

    return df.select(*columns).mapInArrow(run, schema)


def score_many(df: DataFrame, models: list[dict], names: list[str], outs: list[str], p: int, keep: list[str],
               keys: list[str] | None = None, model_keys: list[str] | None = None, fills: list[float] | None = None,
               target: Target = PLAIN_TARGET) -> DataFrame:
    """``score_packed`` for any number of models: as many at once as may be shipped to a task, no shuffle."""
    n_keys = len({tuple(m[k] for k in model_keys or []) for m in models})
    width = max(1, MODEL_NUMBERS // max(1, p * n_keys))
    done: list[str] = []
    for start in range(0, len(names), width):
        part, made = names[start:start + width], outs[start:start + width]
        last = start + width >= len(names)
        chosen = [m for m in models if m["model_key"] in set(part)]
        arrays = model_arrays(chosen, model_keys or [], p, "model_key", part)
        kept = [*keep, *done, *([] if last else [c for c in [*(keys or []), "values"] if c not in keep])]
        df = score_packed(df, arrays, made, p, list(dict.fromkeys(kept)), keys, fills=fills, target=target)
        done += made
    return df.select(*keep, *outs)


def residual(age: Column, pred: Column) -> Column:
    return age - pred


def fused_age(pred: Column, correction: Column) -> Column:
    return pred + correction
