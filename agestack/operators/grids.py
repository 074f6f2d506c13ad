"""Exact medians of packed rows, for all features at once, without a row per cell.

Floating numbers are read as whole numbers of the same order.  A pass counts, for every feature, how many cells fall on each
value of the next few bits, among the cells that share the bits known so far: a grid of counts per task, of bounded size
whatever the number of features, added up by Spark.  The ranks of the two middle cells then fix those bits.  Two passes
find the medians of 32-bit numbers if features are few; ties, infinities and numbers of any spread need no more.

Grids can be subtracted.  Counted per fold, one pass serves the medians of all rows outside each fold as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from .stats import fewer_tasks, matrix

#: Counts that a task keeps at once.
GRID = 1 << 23
#: Bits found in one pass, at most and at least; with more features than a grid holds at the least, they are taken in turns.
MOST_BITS, LEAST_BITS = 16, 4


def ordered_bits(x: np.ndarray, bits: int) -> np.ndarray:
    """Whole numbers in the order of the floating numbers; those that are no number come out anyhow."""
    kind = np.uint32 if bits == 32 else np.uint64
    u = x.astype(np.float32 if bits == 32 else np.float64).view(kind)
    top = kind(1 << (bits - 1))
    return np.where(u & top, ~u, u | top)


def bits_as_floats(keys: np.ndarray, bits: int) -> np.ndarray:
    kind = np.uint32 if bits == 32 else np.uint64
    top = kind(1 << (bits - 1))
    k = keys.astype(kind)
    return np.where(k & top, k ^ top, ~k).astype(kind).view(np.float32 if bits == 32 else np.float64).astype(np.float64)


def _distinct(prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers of each column: a table of them, which of its places are in use, and each entry's place."""
    order = np.argsort(prefix, axis=0, kind="stable")
    sorted_ = np.take_along_axis(prefix, order, axis=0)
    number = np.concatenate([np.zeros((1, prefix.shape[1]), dtype=np.int64), (sorted_[1:] != sorted_[:-1]).cumsum(axis=0)])
    table = np.zeros((int(number.max()) + 1, prefix.shape[1]), dtype=prefix.dtype)
    used = np.zeros(table.shape, dtype=bool)
    columns = np.broadcast_to(np.arange(prefix.shape[1]), prefix.shape)
    table[number, columns], used[number, columns] = sorted_, True
    place = np.empty_like(number)
    np.put_along_axis(place, order, number, axis=0)
    return table, used, place


def count_grid(packed: DataFrame, p: int, columns: slice, known: np.ndarray, used: np.ndarray, left: int, bits: int,
               width: int, fold: str | None, n_folds: int) -> DataFrame:
    """``fold, feature, pre, bin, n``: cells of each feature whose bits above ``left + bits`` are those of ``known[pre]``, by
    their next ``bits`` bits; cells without a value are not counted."""
    m, w = known.shape
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (n_folds * m * w) << bits
        total: np.ndarray | None = None  # made only when there are more cells than it has places
        codes: list[np.ndarray] = []
        held = 0

        for whole in batches:
            step = max(1, GRID // max(p, 1))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                x = matrix(batch.column("values"), p)[:, columns]
                own = np.zeros(len(x), dtype=np.int64)
                if fold is not None:
                    own = batch.column("__fold").to_numpy(zero_copy_only=False).astype(np.int64)
                keys, real = ordered_bits(x, width).astype(np.uint64), ~np.isnan(x)
                for j in range(m):
                    hit = real & used[j]
                    if left + bits < width:
                        hit &= (keys >> np.uint64(left + bits)) == known[j]
                    row, feature = np.nonzero(hit)
                    digit = ((keys[row, feature] >> np.uint64(left)) & mask).astype(np.int64)
                    codes.append(((((own[row] * m + j) * w) + feature) << bits) + digit)
                    held += len(row)
                if held > GRID:
                    part = np.bincount(np.concatenate(codes), minlength=size)
                    total = part if total is None else total + part
                    codes, held = [], 0
        rest = np.concatenate([*codes, np.zeros(0, dtype=np.int64)])
        if total is None:
            seen, n = np.unique(rest, return_counts=True)
        else:
            total = total + np.bincount(rest, minlength=size)
            seen = np.flatnonzero(total)
            n = total[seen]
        cell, digit = seen >> bits, seen & ((1 << bits) - 1)
        for at in range(0, len(seen), 1 << 20):
            part = slice(at, at + (1 << 20))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c.astype(np.int32)) for c in (cell[part] // (m * w), cell[part] % w, cell[part] // w % m, digit[part])]
                + [pa.array(n[part].astype(np.int64))], ["fold", "feature", "pre", "bin", "n"])

    names = [F.col("values")] + ([F.col(fold).cast("int").alias("__fold")] if fold is not None else [])
    return fewer_tasks(packed.select(*names)).mapInArrow(run, "fold int, feature int, pre int, bin int, n long")


def _middles(counts: DataFrame, n_splits: int, lanes: DataFrame | None) -> DataFrame:
    """``held_out, target, feature, bin, before, rank``: where the cell of each rank lies.

    Set ``n_splits`` is all rows, the others are all but a fold's: the total less its own counts.  Without ``lanes`` the ranks are
    those of the middle cells.
    """
    # tasks have added up already; dealt by feature and prefix, sums and running sums need no other shuffle
    counts = counts.repartition("feature", "pre")
    own = [F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"n{f}") for f in range(n_splits)]
    grid = counts.groupBy("feature", "pre", "bin").agg(F.sum("n").alias("n"), *own)
    whole = W.partitionBy("feature", "pre")
    upto = whole.orderBy("bin")
    here = [F.col("n") - F.col(f"n{f}") for f in range(n_splits)] + [F.col("n")]
    sums = grid.select("feature", "pre", "bin", *[c.alias(f"here{h}") for h, c in enumerate(here)],
                       *[F.sum(c).over(upto).alias(f"upto{h}") for h, c in enumerate(here)],
                       *[F.sum(c).over(whole).alias(f"total{h}") for h, c in enumerate(here)])
    sets = F.array(*[F.struct(F.lit(h).alias("held_out"), *[F.col(f"{c}{h}").alias(c) for c in ("here", "upto", "total")])
                     for h in range(len(here))])
    each = sums.select("feature", "pre", "bin", F.explode(sets).alias("s")).select("feature", "pre", "bin", "s.*").filter("here > 0")
    if lanes is None:
        ranks = F.array(F.struct(F.lit(0).alias("target"), F.expr("(total - 1) div 2").alias("rank")),
                        F.struct(F.lit(1).alias("target"), F.expr("total div 2").alias("rank")))
        each = each.withColumn("r", F.explode(ranks)).select("*", "r.*")
    else:
        each = each.join(lanes, ["feature", "pre", "held_out"])
    return each.filter("upto > rank and upto - here <= rank").select(
        "held_out", "target", "feature", "bin", (F.col("upto") - F.col("here")).alias("before"), "rank")


def grid_medians(packed: DataFrame, p: int, fold: str | None = None, n_splits: int = 0) -> np.ndarray:
    """Medians ``[set, feature]`` of the packed columns ``values``; NaN where there is no value.

    The last set is all rows.  With ``fold``, a column of whole numbers from 0 to ``n_splits`` - 1, set ``h`` is all rows outside
    fold ``h``.  Missing cells (NULL or NaN) do not count; infinities do.  As many numbers as sets and features, twice,
    come to the driver.
    """
    width = {"float": 32, "double": 64}[packed.schema["values"].dataType.elementType.typeName()]
    n_folds, sets = max(n_splits, 1), n_splits + 1
    step = max(1, GRID // (n_folds * 2 * sets << LEAST_BITS))
    out = np.full((sets, p), np.nan)
    for at in range(0, p, step):
        columns = slice(at, min(at + step, p))
        w = columns.stop - at
        prefix = np.zeros((sets * 2, w), dtype=np.uint64)
        rank = np.zeros((sets * 2, w), dtype=np.int64)
        found = np.zeros((sets * 2, w), dtype=bool)
        left = width
        while left:
            known, used, place = _distinct(prefix)
            bits = min(MOST_BITS, left, max(1, int(np.log2(GRID / (n_folds * known.size)))))
            left -= bits
            lanes = None
            if left + bits < width:
                lane, feature = np.nonzero(found)
                lanes = packed.sparkSession.createDataFrame(pa.table({
                    "feature": pa.array(feature.astype(np.int32)), "pre": pa.array(place[lane, feature].astype(np.int32)),
                    "held_out": pa.array((lane // 2).astype(np.int32)), "target": pa.array((lane % 2).astype(np.int32)),
                    "rank": pa.array(rank[lane, feature])}))
            counts = count_grid(packed, p, columns, known, used, left, bits, width, fold, n_folds)
            rows = _middles(counts, n_splits, lanes).toArrow()
            held, target, feature, digit, before, ranks = (rows.column(c).to_numpy().astype(np.int64) for c in
                                                           ("held_out", "target", "feature", "bin", "before", "rank"))
            lane = held * 2 + target
            found[:] = False
            found[lane, feature] = True
            prefix[lane, feature] = (prefix[lane, feature] << np.uint64(bits)) | digit.astype(np.uint64)
            rank[lane, feature] = ranks - before
            if not len(rows):
                break
        low, high = (bits_as_floats(prefix[t::2], width) for t in (0, 1))
        with np.errstate(invalid="ignore"):
            middle = np.where(low == high, low, (low + high) / 2)
        out[:, columns] = np.where(found[::2], middle, np.nan)
    return out
