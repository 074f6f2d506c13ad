"""Vectors of whole numbers, as operators on embeddings take them from arrays of fractions."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Components are multiplied by this and rounded down.
SCALE = 256


def whole(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The vectors of a batch of ``kept`` rows, rounded down, one per row."""
    values = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(values.reshape(-1, dims) * SCALE).astype(np.int64)


def _usable() -> Column:
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col("embedding").isNotNull() & (F.size("embedding") > 0) & good


def kept(rows: DataFrame, bits: int) -> tuple[DataFrame, int]:
    """The rows whose vector can be worked with, and their number of components.

    Not kept: vectors that are null, empty, or hold null or non-finite components; those of another length than most
    (of the shorter, if two lengths are as frequent); and those with a component so large that ``dims`` products of two
    would pass 2 ** ``bits`` (for 64 components and 54 bits, from 64,000 on), as whole numbers of 64 bits could not hold the
    results.
    """
    good = rows.filter(_usable())
    sizes = good.groupBy(F.size("embedding").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").first()
    dims = sizes.dims if sizes else 0
    most = isqrt((1 << bits) // max(dims, 1)) / SCALE - 1
    return good.filter((F.size("embedding") == dims) & F.forall("embedding", lambda x: F.abs(x) <= most)), dims
