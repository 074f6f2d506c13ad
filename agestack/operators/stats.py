"""Additive statistics of packed rows: per-feature moments and Gram matrices.

Both stream Arrow batches through numpy inside the tasks and emit small partial results, which Spark adds up.  Moments
shuffle numbers in proportion to tasks and features.  A Gram matrix has as many numbers as features squared, so its rows
are first brought together: what is shuffled is in proportion to rows times features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..session import settle

PARTIAL_BYTES = 256 << 20
PARTIAL_TASKS = 20_000


def fewer_tasks(df: DataFrame) -> DataFrame:
    """Let each task stream several input splits, so that the partial results shuffled stay few.

    ``coalesce`` moves no data and leaves inputs with fewer splits as they are.
    """
    return df.coalesce(PARTIAL_TASKS)


def matrix(column: pa.Array, p: int, fills: np.ndarray | None = None) -> np.ndarray:
    """An Arrow list column as a float64 matrix; missing cells take their feature's fill value.

    Rows of another width than ``p`` are refused: flattened, they would shift all cells behind them.
    """
    if column.null_count:
        raise ValueError(f"{column.null_count} rows have no values")
    widths = np.diff(column.offsets.to_numpy())
    if (widths != p).any():
        raise ValueError(f"rows of {sorted(set(widths[widths != p].tolist()))[:5]} values where the model has {p} features")
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), p)
    if fills is not None:
        gaps = np.isnan(x)
        if gaps.any():
            x = np.where(gaps, fills, x)
    return x


def group_rows(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    if not keys:
        yield (), np.arange(batch.num_rows)
        return
    rows = pa.Table.from_batches([batch.select(keys)]).append_column("__r", pa.array(np.arange(batch.num_rows)))
    grouped = rows.group_by(keys).aggregate([("__r", "list")])
    for row in grouped.to_pylist():
        yield tuple(row[k] for k in keys), np.asarray(row["__r_list"])


def _key_fields(df: DataFrame, keys: list[str]) -> list[T.StructField]:
    return [T.StructField(k, df.schema[k].dataType) for k in keys]


def moments(df: DataFrame, keys: list[str], p: int, y: str, fills: list[float] | None = None) -> DataFrame:
    """Per key and feature index: n and the sums of x, x*x, y, y*y, x*y.

    x is shifted by its fill value and y is taken as it is, so that a constant feature gives exact zeros.
    Without ``fills`` missing cells are left out of every sum.
    """
    shift = np.asarray(fills if fills is not None else [0.0] * p, dtype=np.float64)
    impute = fills is not None
    names = ["n", "sx", "sxx", "sy", "syy", "sxy"]
    fields = _key_fields(df, keys) + [T.StructField("idx", T.IntegerType())]
    schema = T.StructType(fields + [T.StructField(c, T.DoubleType()) for c in names])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for key, sums in totals.items():
                columns = [pa.array([k] * p, type=arrow[i]) for i, k in enumerate(key)]
                columns.append(pa.array(np.arange(p), type=pa.int32()))
                yield pa.RecordBatch.from_arrays(columns + [pa.array(s) for s in sums], [f.name for f in fields] + names)
            totals.clear()

        arrow: list[pa.DataType] = []
        for batch in batches:
            arrow = [batch.schema.field(k).type for k in keys]
            x_all = matrix(batch.column("values"), p, shift if impute else None) - shift
            y_all = np.asarray(batch.column("__y").to_numpy(zero_copy_only=False), dtype=np.float64)
            for key, rows in group_rows(batch, keys):
                x, t = x_all[rows], y_all[rows]
                if impute:
                    here = [np.full(p, float(len(t))), np.full(p, t.sum()), np.full(p, t @ t)]
                else:
                    seen = ~np.isnan(x)
                    x = np.where(seen, x, 0.0)
                    here = [seen.sum(0).astype(np.float64), t @ seen, (t * t) @ seen]
                sums = np.stack([here[0], x.sum(0), np.einsum("ij,ij->j", x, x), here[1], here[2], t @ x])
                totals[key] = totals[key] + sums if key in totals else sums
                if len(totals) * 6 * p * 8 > PARTIAL_BYTES:
                    yield from emit()
        yield from emit()

    rows = df.select(*keys, "values", F.col(y).cast("double").alias("__y")).filter("__y is not null")
    return (
        fewer_tasks(rows).mapInArrow(partial, schema)
        .groupBy(*keys, "idx").agg(*[F.sum(c).alias(c) for c in names])
    )


def brought_together(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """``rows`` dealt so that those of a key lie in at most one task per ``size`` of them (and at least one).

    A key of any size is split by a hash of its values; equal rows alone stay together.
    """
    counts = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).alias("__parts"))
    counts = settle(counts.withColumnsRenamed({k: f"__{k}" for k in keys}), "key-counts")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    marked = rows.join(counts, same) if keys else rows.withColumn("__parts", counts.scalar())
    part = F.pmod(F.xxhash64("values"), F.col("__parts")).alias("__part")
    return marked.select(*rows.columns, part).repartition(*keys, "__part").drop("__part")


def gram(df: DataFrame, keys: list[str], p: int, y: str, fills: list[float] | None = None) -> DataFrame:
    """Per key the upper triangle of Z'Z with Z = [1, x_1..x_p, y], as rows ``(keys, i, j, v)``.

    Groups may be as large as they like: every task adds up its own rows of every key first.
    """
    return gram_parts(df, keys, p, y, fills).groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))


def gram_parts(df: DataFrame, keys: list[str], p: int, y: str, fills: list[float] | None = None) -> DataFrame:
    """The triangles of each task: at most one per key and p rows of it, besides one per key."""
    m = p + 2
    upper = np.triu_indices(m)
    vector = None if fills is None else np.asarray(fills, dtype=np.float64)
    fields = _key_fields(df, keys)
    names = [f.name for f in fields] + ["i", "j", "v"]
    schema = T.StructType(fields + [
        T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("v", T.DoubleType())
    ])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        arrow: list[pa.DataType] = []

        def emit() -> Iterator[pa.RecordBatch]:
            for key, total in totals.items():
                flat = total[upper]
                columns = [pa.array([k] * len(flat), type=arrow[n]) for n, k in enumerate(key)]
                columns += [pa.array(upper[0], type=pa.int32()), pa.array(upper[1], type=pa.int32()), pa.array(flat)]
                yield pa.RecordBatch.from_arrays(columns, names)
            totals.clear()

        for batch in batches:
            arrow = [batch.schema.field(k).type for k in keys]
            z_all = np.empty((batch.num_rows, m))
            z_all[:, 0] = 1.0
            z_all[:, 1:-1] = matrix(batch.column("values"), p, vector)
            z_all[:, -1] = batch.column("__y").to_numpy(zero_copy_only=False)
            for key, rows in group_rows(batch, keys):
                z = z_all[rows]
                product = z.T @ z
                totals[key] = totals[key] + product if key in totals else product
                if len(totals) * m * m * 8 > PARTIAL_BYTES:
                    yield from emit()
        yield from emit()

    rows = df.select(*keys, "values", F.col(y).cast("double").alias("__y")).filter("__y is not null")
    return brought_together(rows, keys, m).mapInArrow(partial, schema)


def simple_stats(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """The same sums for one feature in plain SQL."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"),
        F.sum(a * a).alias("sxx"), F.sum(a * b).alias("sxy"),
    )


def all_but_each_fold(per_fold: DataFrame, keys: list[str], sums: list[str], fold: str = "fold") -> DataFrame:
    """Training statistics of every fold as total minus the fold's own (the table has one row per key and fold)."""
    total = W.partitionBy(*keys)
    return per_fold.select(*keys, fold, *[(F.sum(c).over(total) - F.col(c)).alias(c) for c in sums])
