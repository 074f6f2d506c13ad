"""Fill values: per-feature statistics over all samples, stored so that scoring can reuse them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.scalar import fill_missing, missing_to_null
from ..session import settle
from .align import feature_columns
from .grids import grid_medians
from .ranking import MEDIAN_GROUP_ROWS, exact_median
from .stats import matrix


def fill_values(cells: DataFrame, strategy: str = "median") -> DataFrame:
    """``feature, fill``: median, mean, or 0 per feature; features without any value are left out."""
    if strategy == "median":
        return exact_median(cells, ["feature"], "value", "fill")
    clean = missing_to_null(F.col("value").cast("double"))
    if strategy == "mean":
        return cells.groupBy("feature").agg(F.avg(clean).alias("fill")).filter("fill is not null")
    return cells.select("feature").distinct().withColumn("fill", F.lit(0.0))


def impute_cells(cells: DataFrame, fills: DataFrame) -> DataFrame:
    """Fill missing cells from ``fills``; a feature without a fill value becomes 0."""
    kept = [F.col(c) for c in cells.columns if c != "value"]
    value = fill_missing(F.col("value").cast("double"), F.col("fill"))
    return cells.join(settle(fills, "fills"), "feature", "left").select(*kept, value.alias("value"))


def filter_and_impute(wide: DataFrame, strategy: str = "median", group_rows: int = MEDIAN_GROUP_ROWS) -> DataFrame:
    """Fill the numeric feature columns of a narrow wide table.

    Columns are unpivoted first, so that the median route can be chosen by size as for long tables.
    """
    names = [c for c in feature_columns(wide)]
    if not names:
        return wide
    if strategy == "mean":
        row = wide.agg(*[F.avg(missing_to_null(F.col(c).cast("double"))).alias(c) for c in names]).first()
        fills = row.asDict()
    elif strategy == "median":
        doubles = wide.select(*[F.col(c).cast("double").alias(c) for c in names])
        long = doubles.unpivot([], names, "feature", "value")
        fills = {r["feature"]: r["fill"] for r in
                 exact_median(long, ["feature"], "value", "fill", group_rows).collect()}
    else:
        fills = {}
    return wide.withColumns({
        c: fill_missing(F.col(c).cast("double"), F.lit(fills.get(c)).cast("double")) for c in names
    })


def packed_fills(packed: DataFrame, p: int, strategy: str = "median") -> list[float]:
    """Fill value of every column of a packed matrix, 0 for columns without values."""
    if strategy == "median":
        return np.nan_to_num(grid_medians(packed, p)[0], nan=0.0, posinf=np.inf, neginf=-np.inf).tolist()
    return column_fills(packed.select(F.posexplode("values").alias("idx", "value")), p, strategy, packed.count())


def fold_fills(packed: DataFrame, p: int, fold: str, n_splits: int) -> np.ndarray:
    """Medians ``[held-out fold, feature]`` of the rows outside each fold, and in the last row those of all rows; 0 for columns
    without values."""
    return np.nan_to_num(grid_medians(packed, p, fold, n_splits), nan=0.0, posinf=np.inf, neginf=-np.inf)


def column_fills(cells: DataFrame, p: int, strategy: str = "median", largest: int | None = None) -> list[float]:
    """The same for cells with their column number ``idx``.  As many numbers as the model has features come to
    the driver."""
    if strategy == "median":
        fills = exact_median(cells, ["idx"], "value", "fill", largest=largest)
    else:
        fills = fill_values(cells.withColumnRenamed("idx", "feature"), strategy).withColumnRenamed("feature", "idx")
    by_index = {r["idx"]: r["fill"] for r in fills.collect()}
    return [float(by_index.get(i) or 0.0) for i in range(p)]


def impute_packed(packed: DataFrame, fills: list[float] | np.ndarray, key: str | None = None) -> DataFrame:
    """Packed rows without gaps.  With ``key`` a row takes the line of ``fills`` that its whole number names."""
    vector, where = np.asarray(fills, dtype=np.float64), packed.columns.index("values")
    p = vector.shape[-1]
    schema = T.StructType([T.StructField(f.name, T.ArrayType(T.DoubleType())) if f.name == "values" else f for f in packed.schema])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = vector if key is None else vector[batch.column(key).to_numpy(zero_copy_only=False).astype(np.int64)]
            x = matrix(batch.column(where), p, own)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * p)
            columns = [*batch.columns]
            columns[where] = pa.ListArray.from_arrays(ends, pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return packed.mapInArrow(fill, schema)
