"""Mixing sources to target weights.

Every source is one stream of words: its documents in the order of a seeded hash, repeated as often as its target asks.
The stream is cut into blocks.  A splitting tree over the output shards divides the sources' block quotas: at each node
the left half's quotas are one draw from the multivariate hypergeometric distribution, so every shard gets whole
blocks, no block twice, and each source exactly its quota.  Within a shard the pieces stand in the order of a hash.

Only the quotas (one number per source) and the tree (one number per source and shard) pass through the driver, and only
while they are few; the draw for many sources is made in Spark.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .common import settle, small, text_of, word_count, words_of

HASH_BITS = 60
#: Rows of a source whose running sum is made in one task; a source of any size has as many such parts as it needs.
ROWS_PER_PART = 4096
#: The tree is made on the driver; beyond so many numbers, blocks are drawn in Spark.
TREE_NUMBERS = 4_000_000


def _source_key() -> Column:
    """A text that is never null and sorts like the source by code points, null last."""
    return F.when(F.col("source").isNull(), F.lit("~")).otherwise(F.concat(F.lit("s"), F.col("source")))


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, text_hash`` and the helper column ``__key`` for the source."""
    return docs.select("doc_id", "source", word_count(text_of()).alias("size"), F.xxhash64(text_of()).alias("text_hash")).withColumn(
        "__key", _source_key())


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: int = 2) -> DataFrame:
    """Per source ``__key, source_size, target, __rows``.

    The targets share ``share`` times all words by weight; none exceeds ``limit`` times its source, and what is cut off
    goes to the others by weight.  That is target = min(weight * level, limit * size) with one level for all; the level
    is the largest of (budget - caps of the sources filled first) / (weights of the rest), sources being filled in the
    order of cap / weight.  A source without words has the target 0.
    """
    by_name = W.orderBy("__key")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1))
    each = (
        sizes.groupBy("__key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__rows"))
        .withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * limit)
    )
    filling = W.orderBy(F.col("cap") / F.col("w"), "__key")
    each = each.select(
        "*", F.sum("source_size").over(W.partitionBy()).alias("total"),
        (F.sum("cap").over(filling.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap")).alias("caps"),
        # a frame up to the end would cost the square of the sources
        (F.sum("w").over(W.partitionBy()) - F.sum("w").over(filling.rowsBetween(W.unboundedPreceding, 0)) + F.col("w")).alias("rest"),
    )
    level = F.max((F.col("total") * F.lit(share) - F.col("caps")) / F.col("rest")).over(W.partitionBy())
    return each.withColumn("level", level).select(
        "__key", "source_size", F.least(F.col("w") * F.col("level"), F.col("cap").cast("double")).alias("target"), "__rows"
    )


def splitting_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """For every source (row) and inner node (column, in heap order from 1) the first block of the node's right half.

    Blocks of a source are numbered in drawing order; a node owns a run of them, its left half the first ones.
    ``shards`` is a power of two.
    """
    q = np.asarray(quotas, dtype=np.int64)
    splits = np.zeros((len(q), max(shards, 2)), dtype=np.int64)
    owned = {1: (np.zeros(len(q), dtype=np.int64), q)}
    for node in range(1, shards):
        start, have = owned.pop(node)
        rng = np.random.default_rng([seed, node])
        half = int(have.sum()) // 2
        left = rng.multivariate_hypergeometric(have, half, method="marginals") if half else np.zeros_like(have)
        splits[:, node] = start + left
        owned[2 * node] = (start, left)
        owned[2 * node + 1] = (start + left, have - left)
    return splits


def drawn_runs(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``__key, __runs``: per source with blocks ``(first, shard)``, the first block of each shard that has any, in order.

    The draw of the splitting tree for any number of sources.  In the order of a seeded hash of all blocks each node's left
    half takes the first ones, so it has as many as in the tree and a source's share of them has the same distribution.
    A block's rank is found by counts of hash ranges, then within its range.
    """
    total = quotas.agg(F.sum("quota")).first()[0] or 0
    levels = shards.bit_length() - 1
    bits = min((total // ROWS_PER_PART).bit_length() + 1, 32)
    blocks = quotas.filter("quota > 0").select(
        "__key", "quota", F.explode(F.expr(f"sequence(0L, (quota - 1) div {ROWS_PER_PART})")).alias("chunk"))
    each = f"sequence(chunk * {ROWS_PER_PART}, least((chunk + 1) * {ROWS_PER_PART}, quota) - 1)"
    blocks = blocks.repartition("__key", "chunk").select("__key", F.explode(F.expr(each)).alias("b"))
    blocks = blocks.withColumn("h", F.xxhash64(F.lit(seed), "__key", "b")).withColumn("range", F.shiftright("h", 64 - bits))
    ranges = blocks.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, 0))
    ranges = ranges.select("range", (upto - F.col("n")).alias("before"))
    place = F.row_number().over(W.partitionBy("range").orderBy("h", "__key", "b")) - 1
    ranked = blocks.withColumn("place", place).join(ranges, "range").select("__key", (F.col("before") + F.col("place")).alias("rank"))
    shard = f"""aggregate(sequence(1, {levels}), named_struct('n', 1, 'r', rank, 't', {total}L), (a, i) ->
        if(a.r >= a.t div 2, named_struct('n', a.n * 2 + 1, 'r', a.r - a.t div 2, 't', a.t - a.t div 2),
           named_struct('n', a.n * 2, 'r', a.r, 't', a.t div 2)), a -> a.n - {shards})""" if levels else "0"
    counts = ranked.groupBy("__key", F.expr(shard).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    runs = counts.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("c"))
    first = "aggregate(slice(c, 1, i), 0L, (s, y) -> s + y.n)"
    return runs.select("__key", F.expr(f"transform(c, (x, i) -> named_struct('first', {first}, 'shard', x.shard))").alias("__runs"))


def placed(sizes: DataFrame, sources: DataFrame, seed: int, runs: DataFrame | None = None) -> DataFrame:
    """Adds ``start``, the words of its source that stand before a document, and the columns of ``runs`` if given.

    The running sum has two steps, so that a large source does not meet in one task: sums of hash ranges, then rows
    within a range.
    """
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")
    bits = F.greatest(F.ceil(F.log2(F.col("__rows") / ROWS_PER_PART)), F.lit(0)).cast("int")
    rows = sizes.join(small(sources), "__key").withColumn("__h", h)
    rows = rows.withColumn("__part", F.call_function("shiftright", F.col("__h"), F.lit(HASH_BITS) - bits))
    parts = rows.groupBy("__key", "__part").agg(F.sum("size").alias("__in"))
    before = W.partitionBy("__key").orderBy("__part").rowsBetween(W.unboundedPreceding, 0)
    parts = parts.select("__key", "__part", (F.sum("__in").over(before) - F.col("__in")).alias("__before"))
    if runs is not None:  # to the parts, so that the rows of a large source do not meet
        parts = parts.join(runs, "__key", "left")
    within = W.partitionBy("__key", "__part").orderBy("__h", "doc_id", "size", "text_hash").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("__upto", F.sum("size").over(within))
    return rows.join(parts, ["__key", "__part"]).withColumn("start", F.col("__before") + F.col("__upto") - F.col("size"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: int = 2,
        shards: int = 64, block_words: int = 2048, seed: int = 7) -> DataFrame:
    """One row per document: ``doc_id, source, size, text_hash, source_size, target, taken`` and ``pieces``.

    ``pieces`` lists what the mix takes: ``shard``, ``place`` (order within the shard), ``block``, and the words ``first``
    up to ``last`` (exclusive) of the document.  A source's pieces add up to its target, rounded to words; the last
    block is cut to fit.  A document is taken at most ``limit`` times.

    Null texts and texts without words have size 0 and no pieces.  A null source is a source of its own, last in order.
    Rows that repeat a doc_id are documents of their own.  No rows give no rows.  Other columns are ignored.
    """
    if shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    sizes = sized(docs)
    spark = docs.sparkSession
    sources = settle(targets(sizes, weights, share, limit), "mix-sources")
    quotas = sources.select("__key", F.ceil(F.round("target") / block_words).cast("long").alias("quota"))
    few = quotas.orderBy("__key").limit(TREE_NUMBERS // shards + 1).collect()
    levels = shards.bit_length() - 1
    if len(few) * shards <= TREE_NUMBERS:
        tree = splitting_tree([r.quota for r in few], shards, seed)
        schema = T.StructType([T.StructField("__key", T.StringType()), T.StructField("__splits", T.ArrayType(T.LongType()))])
        splits = spark.createDataFrame([(r["__key"], tree[i].tolist()) for i, r in enumerate(few)], schema)
        rows = placed(sizes, sources, seed).join(small(splits), "__key")
        shard = f"aggregate(sequence(1, {levels}), 1, (n, i) -> n * 2 + if(b >= __splits[n], 1, 0)) - {shards}" if levels else "0"
    else:
        rows = placed(sizes, sources, seed, settle(drawn_runs(quotas, shards, seed), "mix-runs"))
        shard = "element_at(filter(__runs, r -> r.first <= b), -1).shard"
    passes = ", ".join(f"{p}L" for p in range(limit))
    pieces = f"""
        flatten(transform(array({passes}), p -> transform(
            if(least(start + p * source_size + size, __words) > start + p * source_size,
               sequence((start + p * source_size) div {block_words},
                        (least(start + p * source_size + size, __words) - 1) div {block_words}),
               array()),
            b -> named_struct(
                'shard', {shard}, 'place', xxhash64({seed}, __key, b, doc_id, p), 'block', b,
                'first', greatest(b * {block_words} - (start + p * source_size), 0L),
                'last', least((b + 1) * {block_words}, start + p * source_size + size, __words) - (start + p * source_size)
            ))))"""
    return (
        rows.withColumn("__words", F.round("target").cast("long")).withColumn("pieces", F.expr(pieces))
        .select("doc_id", "source", "size", "text_hash", "source_size", "target",
                F.expr("aggregate(pieces, 0L, (s, x) -> s + x.last - x.first)").alias("taken"), "pieces")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents the mix takes, all columns, with ``size, source_size, target, taken, pieces`` of ``mix``.

    Columns of these names in ``docs`` give way.  Of rows that agree in doc_id, source and text the columns of any one
    are used for all.
    """
    names = ("size", "source_size", "target", "taken", "pieces")
    plan = mix(docs, **options).filter("taken > 0").select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("text_hash").alias("__th"), *names)
    rows = docs.drop(*names).withColumn("__mine", F.xxhash64(text_of())).dropDuplicates(["doc_id", "source", "__mine"])
    same = (F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source"))
            & (F.col("__mine") == F.col("__th")))
    return rows.join(plan, same).drop("__id", "__source", "__th", "__mine")


def shard_rows(docs: DataFrame, shards: int = 64, **options) -> DataFrame:
    """The mixed corpus: ``shard, place, doc_id, source, text``, one row per piece, in order within each shard.

    A piece's text is its words joined by one space.
    """
    rows = mixed_documents(docs, shards=shards, **options).select("doc_id", "source", "text", F.explode("pieces").alias("x"))
    piece = F.slice(words_of(text_of()), (F.col("x.first") + 1).cast("int"), (F.col("x.last") - F.col("x.first")).cast("int"))
    return (
        rows.select("x.shard", "x.place", "doc_id", "source", F.array_join(piece, " ").alias("text"))
        .repartition("shard").sortWithinPartitions("shard", "place", "doc_id")
    )
