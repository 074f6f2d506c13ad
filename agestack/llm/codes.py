"""Vector code compression: each part of a vector is replaced by the number of its nearest codebook entry.

The search is that of fixed pivots.  Every part's distances to a few pivots are measured once and kept.  In each round
the pivots' distances to the codebook's entries are measured; the difference of the two distances to a pivot is never more
than the distance of part and entry.  So a part looks at the entries in the order of that bound and stops at the first one
whose bound exceeds the best exact distance.  All exact distances are of whole numbers.

Counts and sums of each entry's parts are added up per task and then by Spark; a codebook has a fixed number of numbers
and is all that reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import vectors
from .common import settle, small

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Pivots of each part position.
PIVOTS = 3
#: Vectors worked on together.
CHUNK = 512
#: Copies of the sums of labels where there are too many to send to every task.
SALTS = 16


def choose_pivots(entries: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Of a codebook's entries, ``n`` that lie far from each other: first the one farthest from the mean."""
    gap = ((entries - entries.mean(axis=0)) ** 2).sum(axis=1)
    chosen = []
    for _ in range(min(n, len(entries))):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(((entries - entries[chosen[-1]]) ** 2).sum(axis=1), gap if len(chosen) > 1 else np.inf)
    return entries[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """From each row of ``x`` to each pivot, in the precision in which they are kept."""
    return np.sqrt(((x[:, None, :] - pivots[None]) ** 2).sum(axis=2).astype(np.float64)).astype(np.float32)


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Per row of ``x`` the number of its nearest entry (of equally near ones the first) and the squared distance, exact;
    and how many exact distances that took."""
    from_entries = distances(entries, pivots)
    low = np.zeros((len(x), len(entries)))
    for p in range(pivots.shape[0]):
        a, b = to_pivots[:, p, None].astype(np.float64), from_entries[None, :, p].astype(np.float64)
        # less what rounding may have added
        np.maximum(low, np.abs(a - b) - 1e-6 * (a + b) - 1e-6, out=low)
    order = np.argsort(low, axis=1, kind="stable")
    best = np.full(len(x), np.iinfo(np.int64).max)
    number = np.zeros(len(x), dtype=np.int64)
    open_, looked = np.arange(len(x)), 0
    for k in range(len(entries)):
        entry = order[open_, k]
        stays = low[open_, entry] ** 2 <= best[open_]
        open_, entry = open_[stays], entry[stays]
        if not len(open_):
            break
        exact = ((x[open_] - entries[entry]) ** 2).sum(axis=1)
        looked += len(open_)
        better = (exact < best[open_]) | ((exact == best[open_]) & (entry < number[open_]))
        best[open_[better]], number[open_[better]] = exact[better], entry[better]
    return number, best, looked


def _rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of ``measured`` rows with their parts ``[vector, position, component]`` and distances to the pivots."""
    for whole_batch in batches:
        for at in range(0, whole_batch.num_rows, CHUNK):
            batch = whole_batch.slice(at, CHUNK)
            parts = np.frombuffer(b"".join(batch.column("parts").to_pylist()), dtype=np.int32).reshape(-1, PARTS, width)
            to_pivots = np.frombuffer(b"".join(batch.column("to_pivots").to_pylist()), dtype=np.float32).reshape(len(parts), PARTS, -1)
            yield batch, parts.astype(np.int64), to_pivots


def measured(rows: DataFrame, dims: int, pivots: np.ndarray) -> DataFrame:
    """``vec_id, label, parts, to_pivots``: whole numbers and distances to the pivots, in part order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = vectors.whole(batch, dims)
            parts = x.reshape(len(x), PARTS, -1)
            far = np.stack([distances(parts[:, p], pivots[p]) for p in range(PARTS)], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([r.tobytes() for r in x.astype(np.int32)], pa.binary()),
                 pa.array([r.tobytes() for r in far], pa.binary())], ["vec_id", "label", "parts", "to_pivots"])

    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([T.StructField("vec_id", kinds["vec_id"]), T.StructField("label", kinds["label"]),
                           T.StructField("parts", T.BinaryType()), T.StructField("to_pivots", T.BinaryType())])
    return rows.select("vec_id", "label", "embedding").mapInArrow(run, schema)


def next_books(table: DataFrame, books: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Each entry's parts' mean, rounded down; entries without parts stay."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(books.shape[:2], dtype=np.int64)
        sums = np.zeros(books.shape, dtype=np.int64)
        for _, parts, to_pivots in _rows(batches, width):
            for p in range(PARTS):
                number, _, _ = nearest(parts[:, p], to_pivots[:, p], books[p], pivots[p])
                counts[p] += np.bincount(number, minlength=books.shape[1])
                np.add.at(sums[p], number, parts[:, p])
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]),
             pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    added = table.mapInArrow(run, "part int, entry int, n long, sums array<long>").groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums"))
    after = books.copy()
    for row in added.collect():  # at most PARTS * ENTRIES rows
        after[row.part, row.entry] = [s // row.n for s in row.sums]
    return after


def coded(table: DataFrame, books: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error``: the entries' numbers in part order, two hex digits each, and the summed distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, parts, to_pivots in _rows(batches, books.shape[2]):
            numbers = np.empty((len(parts), PARTS), dtype=np.uint8)
            error = np.zeros(len(parts), dtype=np.int64)
            for p in range(PARTS):
                number, best, _ = nearest(parts[:, p], to_pivots[:, p], books[p], pivots[p])
                numbers[:, p] = number
                error += best
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([r.tobytes().hex() for r in numbers], pa.string()), pa.array(error)],
                ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType for f in table.schema.fields}
    schema = T.StructType([T.StructField("vec_id", kinds["vec_id"]), T.StructField("label", kinds["label"]),
                           T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return table.mapInArrow(run, schema)


def train(rows: DataFrame, dims: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The measured rows, the codebooks ``[part, entry, component]`` after all rounds, and the pivots."""
    if dims % PARTS:
        raise ValueError(f"{dims} components do not make {PARTS} equal parts")
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).select("embedding").collect()
    first = np.floor(np.array([s.embedding for s in seeds], dtype=np.float64) * vectors.SCALE).astype(np.int64)
    books = np.ascontiguousarray(first.reshape(len(first), PARTS, -1).swapaxes(0, 1))
    pivots = np.stack([choose_pivots(b) for b in books])
    table = settle(measured(rows, dims, pivots), "vector-parts")
    for _ in range(ROUNDS):
        books = next_books(table, books, pivots)
    return table, books, pivots


def compress(rows: DataFrame) -> DataFrame:
    """Per vector ``vec_id, code, error, label_error, codebooks_sha256``.

    The codebook of each of 16 part positions starts as that part of the vectors of the 64 smallest ids (fewer, if there
    are fewer vectors; rows without an id come last, equal ids in the order of their vectors) and is moved to the means of
    its parts twice.  ``label_error`` is the sum of ``error`` over the rows of a label, those without one together.

    Rows that ``vectors.kept`` does not keep are left out.  Repeated rows are vectors of their own.  Without any vector
    there are no rows.  Vectors whose length 16 does not divide are refused.  Other columns are ignored.
    """
    good, dims = vectors.kept(rows.select("vec_id", "label", "embedding"), 60)
    if not dims:
        return good.select("vec_id", F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")],
                           F.lit("").alias("codebooks_sha256"))
    table, books, pivots = train(good, dims)
    found = settle(coded(table, books, pivots), "vector-codes")
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    sums = settle(found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    same = F.col("label").eqNullSafe(F.col("of"))
    few = small(sums)
    if few is sums:  # too many labels for every task: rows of one label go to several
        few = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = found.withColumn("own", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
        same = same & (F.col("own") == F.col("salt"))
    return found.join(few, same).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
