"""Hard negatives: for each anchor and each of its nearest rows of the same label, the nearest rows of other labels whose
score lies in a window below the positive's.

The windows of one anchor overlap.  Their upper limits cut the scores into slots that do not: a slot reaches from one limit
down to the next.  Rows of another label are put into their slot, and only the best few of each slot are kept, by every task
and again by Spark.  Merged from the lowest slot upwards, the slots give for each limit the best few rows at or below it; of
these, a positive takes those not below its own lower limit.

All anchors meet all rows, in blocks.  A block of rows goes to one lane; a block of anchors (a wave) goes to every lane, and
is kept in a task only while its rows of the lane pass.  Scores are products of matrices of whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import vectors
from .common import settle

#: Rows of a block, and anchors of a wave.
BLOCK = 1024
#: Blocks that a lane holds at least, where there are enough of them; with few blocks a lane has one.
LANE_BLOCKS = 64
#: Blocks given to Python at a time.
BATCH = 8
#: Scores stay below 2 ** 53, so that products of floating numbers are exact.
BITS = 53
#: Stands for rows without an id, which come last among equal scores.
_NO_ID = np.iinfo(np.int64).max

_BLOCK = "block long, rows binary, ids binary, labels binary, vectors binary, limits binary"
_FOUND = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])


def blocks(rows: DataFrame, dims: int) -> DataFrame:
    """``rows`` (``row, vec_id, label, vector``, ``limits``) packed, up to ``BLOCK`` to a block."""
    size = BLOCK

    def pack(table: pa.Table, number: int) -> pa.RecordBatch:
        ids = table.column("vec_id").fill_null(_NO_ID).to_numpy()
        order = np.argsort(ids, kind="stable")
        matrix = np.frombuffer(b"".join(table.column("vector").to_pylist()), dtype=np.int32).reshape(-1, dims)[order]
        limits = np.array(table.column("limits").to_pylist(), dtype=np.int64)[order]
        columns = [table.column("row").to_numpy()[order], ids[order], table.column("label").to_numpy()[order], matrix, limits]
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), *(pa.array([c.tobytes()], pa.binary()) for c in columns)],
            ["block", "rows", "ids", "labels", "vectors", "limits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, n, number = [], 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                held.append(batch.slice(at, size))
                n += held[-1].num_rows
                while n >= size:
                    table = pa.Table.from_batches(held)
                    yield pack(table.slice(0, size), number)
                    held, n, number = table.slice(size).to_batches(), n - size, number + 1
        if n:
            yield pack(pa.Table.from_batches(held), number)

    return rows.select("row", "vec_id", "label", "vector", "limits").mapInArrow(run, _BLOCK)


def best(anchor: np.ndarray, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each anchor and slot: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, slot, anchor))
    a, s = anchor[order], slot[order]
    begins = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1])])) if len(a) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(begins, len(a)))
    return order[np.arange(len(a)) - np.repeat(begins, sizes) < k]


def _numbers(data: bytes, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(data, dtype=kind)


def scan(lanes: DataFrame, dims: int, k: int, pick: Callable) -> DataFrame:
    """``anchor, slot, score, id`` of what ``pick`` takes from each wave and block, cut to ``k`` per slot.

    ``pick`` gets a wave, a block and gives places of anchors, slots, scores and places of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wave, held, n = None, [], 0

        def cut() -> list[np.ndarray]:
            columns = [np.concatenate(c) for c in zip(*held)]
            keep = best(*columns, k)
            return [c[keep] for c in columns]

        def out(columns: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if wave is None or wave["wave"] != row["wave"]:
                    if held:
                        yield out(cut())
                    wave, held, n = {c: row[c] for c in row if c.startswith("w")}, [], 0
                    wave["matrix"] = _numbers(row["wvectors"], np.int32).reshape(-1, dims).astype(np.float64)
                block = {"matrix": _numbers(row["vectors"], np.int32).reshape(-1, dims).astype(np.float64),
                         **{c: _numbers(row[c]) for c in ("rows", "ids", "labels")}}
                where, slot, score, place = pick(wave, block)
                held.append([_numbers(wave["wrows"])[where], slot, score, block["ids"][place]])
                n += len(where)
                if n > 1_000_000:
                    held = [cut()]
                    n = len(held[0][0])
        if held:
            yield out(cut())

    return lanes.mapInArrow(run, "anchor long, slot int, score long, id long")


def positives_of(k: int) -> Callable:
    """Other rows of the anchor's label; all are in one slot."""

    def pick(wave: dict, block: dict):
        rows, labels = _numbers(wave["wrows"]), _numbers(wave["wlabels"])
        parts = []
        for label in np.intersect1d(labels, block["labels"]):
            a, b = np.flatnonzero(labels == label), np.flatnonzero(block["labels"] == label)
            scores = (wave["matrix"][a] @ block["matrix"][b].T).astype(np.int64)
            wanted = rows[a][:, None] != block["rows"][b][None]
            if len(b) > k + 1:  # one of them may be the anchor itself
                wanted &= scores >= np.partition(scores, len(b) - k - 1, axis=1)[:, len(b) - k - 1, None]
            x, y = np.nonzero(wanted)
            parts.append((a[x], scores[x, y], b[y]))
        where, score, place = (np.concatenate([*c, np.zeros(0, dtype=np.int64)]).astype(np.int64) for c in zip(*parts or [((),) * 3]))
        return where, np.zeros(len(where), dtype=np.int64), score, place

    return pick


def negatives_in(wave: dict, block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of other labels in the slots of the anchor's upper limits, which descend; its lowest limit follows them."""
    labels = _numbers(wave["wlabels"])
    limits = _numbers(wave["wlimits"]).reshape(len(labels), -1)
    upper, low = limits[:, :-1], limits[:, -1]
    scores = (wave["matrix"] @ block["matrix"].T).astype(np.int64)
    x, y = np.nonzero((scores <= upper[:, :1]) & (scores >= low[:, None]) & (labels[:, None] != block["labels"][None]))
    found = scores[x, y]
    slot = (upper[x] >= found[:, None]).sum(axis=1) - 1  # the last of the limits that still allow it
    return x, slot, found, y


def waves_of(anchors: DataFrame, dims: int) -> DataFrame:
    """Blocks of ``anchors`` with a number ``wave`` from 0; the driver sees a number per ``BLOCK`` anchors."""
    spark = anchors.sparkSession
    packed = settle(blocks(anchors.repartition(-(-anchors.count() // BLOCK)), dims), "anchor-waves", BLOCK)
    order = [r.block for r in packed.select("block").orderBy("block").collect()]
    names = spark.createDataFrame(list(zip(order, range(len(order)))), "block long, wave int")
    renamed = [F.col(c).alias(f"w{c}") for c in packed.columns if c not in ("block", "ids")]
    return packed.join(names, "block").select("wave", *renamed)


def in_lanes(blocked: DataFrame, waves: DataFrame) -> DataFrame:
    """Every wave beside every block; the blocks of one wave and lane come after each other in one task."""
    spark = blocked.sparkSession
    n, n_waves = blocked.count(), waves.count()
    lanes = max(1, min(n, max(2 * spark.sparkContext.defaultParallelism, -(-n // LANE_BLOCKS))))
    tasks = max(lanes, min(lanes * n_waves, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    left = blocked.withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int")).withColumn(
        "wave", F.explode(F.sequence(F.lit(0), F.lit(n_waves - 1))))
    right = waves.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    # as many tasks as asked for, however few bytes they get: the work is in the products
    left, right = (side.repartition(tasks, "wave", "lane") for side in (left, right))
    return left.join(right.hint("merge"), ["wave", "lane"]).drop("block", "lane", "limits")


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3,
                   low: int = 50, high: int = 95) -> DataFrame:
    """Per anchor, positive and rank ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Scores are inner products of vectors of whole numbers (256 times each component, rounded down); higher ones come first,
    equal ones by ``vec_id``, rows without an id last.  The positives are the first ``positives`` other rows of the anchor's
    label.  Each takes the first ``negatives`` rows of other labels whose score is at least ``low`` and at most ``high``
    hundredths of its own (0 <= low <= high); a positive without any, or with a negative score, has no row.

    Rows without a label, and those that ``vectors.kept`` does not keep, take no part.  Repeated rows are rows of their own,
    also as anchors.  Rows for which ``anchor`` is null are no anchors.  No rows give no rows.  Other columns are ignored.
    """
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    chosen = rows.filter(F.col("label").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding",
        F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    good, dims = vectors.kept(chosen, BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = vectors.whole(batch, dims).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in ("vec_id", "label", "is_anchor")] + [pa.array([r.tobytes() for r in x], pa.binary())],
                    ["vec_id", "label", "is_anchor", "vector"])

    whole = good.mapInArrow(run, "vec_id long, label long, is_anchor boolean, vector binary")
    whole = settle(whole.select("*", F.monotonically_increasing_id().alias("row"), F.array().cast("array<long>").alias("limits")), "whole-vectors")
    anchors = whole.filter("is_anchor")
    if not anchors.limit(1).count():
        return rows.sparkSession.createDataFrame([], result)
    blocked = settle(blocks(whole, dims), "vector-blocks", BLOCK)

    by_slot = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    best_of = lambda df, k: df.withColumn("rank", F.row_number().over(by_slot)).filter(F.col("rank") <= k)
    near = settle(scan(in_lanes(blocked, waves_of(anchors, dims)), dims, positives, positives_of(positives)), "positives", BATCH)
    listed = best_of(near, positives).filter("score >= 0").groupBy(F.col("anchor").alias("row")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("list"))  # one to ``positives`` of them
    upper = f"transform(list, p -> p.score * {int(high)} div 100)"
    limits = F.expr(f"concat({upper}, array_repeat({-(1 << 62)}, {int(positives)} - size(list)), "
                    f"array((element_at(list, -1).score * {int(low)} + 99) div 100))")
    seeking = anchors.drop("limits").join(listed, "row").withColumn("limits", limits)
    seeking = settle(seeking.select("row", "vec_id", "label", "vector", "limits", "list"), "windows")
    if not seeking.limit(1).count():
        return rows.sparkSession.createDataFrame([], result)
    far = settle(scan(in_lanes(blocked, waves_of(seeking, dims)), dims, negatives, negatives_in), "negatives", BATCH)
    slots = best_of(far, negatives).groupBy(F.col("anchor").alias("row")).agg(
        F.collect_list(F.struct("slot", (-F.col("score")).alias("down"), "id")).alias("kept"))  # ``negatives`` per slot at most
    return windows(seeking.select("row", F.col("vec_id").alias("anchor_id"), "list").join(slots, "row"), positives, negatives, low)


def windows(found: DataFrame, positives: int, negatives: int, low: int) -> DataFrame:
    """The slots of each anchor, merged from the lowest one up, and what each positive takes of them."""
    merged = F.expr(f"""aggregate(sequence({positives - 1}, 0, -1), array(cast(array() as array<struct<down: bigint, id: bigint>>)),
        (above, j) -> concat(array(slice(array_sort(concat(above[0],
            transform(filter(kept, x -> x.slot = j), x -> struct(x.down as down, x.id as id)))), 1, {negatives})), above))""")
    each = found.select("anchor_id", merged.alias("merged"), F.posexplode("list").alias("j", "positive"))
    inside = F.filter(F.get("merged", F.col("j")), lambda x: -x["down"] * 100 >= F.col("positive.score") * low)
    taken = each.select("anchor_id", "positive", F.posexplode(inside).alias("at", "negative"))
    known = lambda c: F.when(F.col(c) != int(_NO_ID), F.col(c))
    return taken.select(
        "anchor_id", known("positive.id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"),
        known("negative.id").alias("negative_id"), F.col("positive.score").alias("positive_score"),
        (-F.col("negative.down")).alias("negative_score"))
