"""Row numbers and medians of groups that are too large for one task.

A window over a hot key would sort all its rows in one task.  Here an ordered bucket is derived from the
sort key first; the rows per bucket are counted (combined before the shuffle), the counts are added up
per key, and only rows that share key *and* bucket are ever sorted together.  The numbers are the same as
those of the plain window.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalar import missing_to_null, seeded_hash
from ..session import settle

MEDIAN_GROUP_ROWS = 1 << 17
VALUE_BUCKETS = 512


def bucket_rank(
    df: DataFrame,
    keys: list[str],
    buckets: list[Column],
    order: list[Column],
    out: str = "rn",
    at_most: Column | int | None = None,
) -> DataFrame:
    """``row_number() over (partition by keys order by order)``; ``buckets`` must ascend with ``order``.

    With ``at_most`` only rows numbered up to it are returned, and buckets wholly beyond it are dropped
    before any row is shuffled.  It may be a column of ``df`` that is constant within the keys.
    """
    names = [f"__b{i}" for i in range(len(buckets))]
    bounded = at_most is not None
    tagged = df.withColumns(dict(zip(names, buckets)))
    extra = []
    if bounded:
        tagged = tagged.withColumn("__most", at_most if isinstance(at_most, Column) else F.lit(at_most))
        extra = [F.max("__most").alias("__most")]
    sizes = tagged.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("__n"), *extra)
    earlier = W.partitionBy(*keys).orderBy(*names).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    if bounded:
        offsets = offsets.filter(F.col("__before") < F.col("__most"))
        tagged = tagged.drop("__most")
    offsets = settle(offsets.drop("__n"), "offsets")
    inside = W.partitionBy(*keys, *names).orderBy(*order)
    ranked = tagged.join(offsets, keys + names).withColumn(
        out, (F.col("__before") + F.row_number().over(inside)).cast("long")
    )
    if bounded:
        ranked = ranked.filter(F.col(out) <= F.col("__most")).drop("__most")
    return ranked.drop("__before", *names)


def hash_rank(
    df: DataFrame,
    keys: list[str],
    id_col: str,
    seed: Column | int,
    out: str = "rn",
    at_most: Column | int | None = None,
) -> DataFrame:
    """Number the rows of each key in seeded random order (4,096 buckets per key)."""
    tagged = df.withColumn("__h", seeded_hash(F.col(id_col), seed))
    head = F.substring("__h", 1, 3)
    return bucket_rank(tagged, keys, [head], [F.col("__h"), F.col(id_col)], out, at_most).drop("__h")


def hash_head(df: DataFrame, keys: list[str], id_col: str, limits: DataFrame, out: str = "rn") -> DataFrame:
    """The rows that ``hash_rank`` numbers up to ``most``, for keys of known size, from one pass that hashes each row once.

    ``limits`` has ``keys, n`` (rows of the key), ``most, seed``; rows of other keys are left out.  Hashes are spread evenly, so
    the first rows of a key lie below a cut a little above ``most / n``; only rows below it are written and ranked.  A key with
    too few rows there is read again with a cut eight times as high, at last with all its rows: the cut never decides the result.
    """
    most, share = F.col("most"), F.col("__share")
    left = settle(limits.withColumn("__share", (most + 8 * F.sqrt(most) + 16) / F.col("n")), "limits")
    parts: list[DataFrame] = []
    while True:
        digits = F.lpad(F.lower(F.hex(F.floor(share * 16777216))), 6, "0")
        cuts = left.select(*keys, "most", "seed", F.when(share < 1, digits).otherwise("g").alias("__cut"))
        tagged = df.join(cuts, keys).withColumn("__h", seeded_hash(F.col(id_col), F.col("seed")))
        head = settle(tagged.filter(F.substring("__h", 1, 6) < F.col("__cut")).drop("seed", "__cut"), "heads")
        counts = head.groupBy(*keys).agg(F.count(F.lit(1)).alias("__found"))
        few = F.coalesce("__found", F.lit(0)) < F.least("most", "n")
        short = settle(left.join(counts, keys, "left").filter(few & (share < 1)).drop("__found"), "short")
        if short.isEmpty():
            parts.append(head)
            break
        parts.append(head.join(short.select(*keys), keys, "left_anti"))
        left = short.withColumn("__share", share * 8)
    heads = functools.reduce(DataFrame.unionByName, parts)
    return bucket_rank(heads, keys, [F.substring("__h", 1, 3)], [F.col("__h"), F.col(id_col)], out, most).drop("__h", "most")


def strength_rank(df: DataFrame, keys: list[str], strength: str, tie: str, out: str = "rn",
                  at_most: Column | int | None = None) -> DataFrame:
    """Number rows by falling ``strength`` in [0, 1], ties by rising integer ``tie``.

    Equal strengths (such as the zeros of constant features) may fill one bucket, so the buckets of
    strength zero are cut again by ``tie``.
    """
    level = F.floor((F.lit(1.0) - F.col(strength)) * 1024)
    zeros = F.when(F.col(strength) == 0, F.floor(F.col(tie) / 65536)).otherwise(F.lit(0))
    return bucket_rank(df, keys, [level, zeros], [F.col(strength).desc(), F.col(tie)], out, at_most)


def number_rows(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Number all rows of a table 1..n in the given order, without one global window.

    Rows are cut into ranges of about equal size, whatever the distribution of the keys.  The ranges are
    written once, so that counting and numbering see the same cuts.
    """
    ranges = settle(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")
    return bucket_rank(ranges, [], [F.col("__p")], [F.col(c) for c in order], out).drop("__p")


def _median_ranks() -> tuple[Column, Column]:
    """The two middle ranks among ``__n`` values, counted from the first value of the current range."""
    return (F.floor((F.col("__n") + 1) / 2) - F.col("__below")), (F.floor(F.col("__n") / 2) + 1 - F.col("__below"))


def _in_range(cells: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """The values inside their key's current range, each with the state of its key."""
    if keys:
        marked = cells.join(state, keys)
    else:
        row = state.first()
        marked = cells.withColumns({c: F.lit(row[c]) for c in state.columns})
    return marked.filter((F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi")))


def _narrowed(cells: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Cut each key's range into equal buckets, count them, keep the one or two that hold the middle ranks."""
    half = F.col("__lo") * 0.5
    share = (F.col("__v") * 0.5 - half) / (F.col("__hi") * 0.5 - half)
    bucket = F.when(F.col("__lo") == F.col("__hi"), F.lit(0)).otherwise(
        F.least(F.floor(share * VALUE_BUCKETS), F.lit(VALUE_BUCKETS - 1))
    )
    counted = _in_range(cells, state, keys).withColumn("__b", bucket).groupBy(*keys, "__b").agg(
        F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__min"), F.max("__v").alias("__max"),
        F.max("__n").alias("__n"), F.max("__below").alias("__below"),
    )
    counted = counted.withColumn("__upto", F.sum("__c").over(W.partitionBy(*keys).orderBy("__b")))
    first, last = _median_ranks()
    middle = counted.filter((F.col("__upto") >= first) & (F.col("__upto") - F.col("__c") < last))
    return middle.groupBy(*keys).agg(
        F.max("__n").alias("__n"), F.min("__min").alias("__lo"), F.max("__max").alias("__hi"),
        F.min(F.col("__below") + F.col("__upto") - F.col("__c")).alias("__below"), F.sum("__c").alias("__inside"),
    )


def narrowing_median(df: DataFrame, keys: list[str], value: str, out: str = "median",
                     group_rows: int = MEDIAN_GROUP_ROWS) -> DataFrame:
    """Exact median for groups of any size.

    Each round counts 512 value ranges per key (combined before the shuffle) and keeps the range with the
    median, until what is left of every key is small; the median is then found among the distinct values
    left.  One or two rounds are usual; values that differ only in their last bits take seven at most.
    """
    cells = df.select(*keys, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    return _narrow_from(cells, _value_ranges(cells, keys), keys, out, group_rows)


def _value_ranges(cells: DataFrame, keys: list[str]) -> DataFrame:
    return settle(cells.groupBy(*keys).agg(
        F.count("__v").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"),
        F.lit(0).cast("long").alias("__below"), F.count("__v").alias("__inside"),
    ), "ranges")


def _narrow_from(cells: DataFrame, state: DataFrame, keys: list[str], out: str, group_rows: int) -> DataFrame:
    open_width, previous = F.sum(F.col("__hi") * 0.5 - F.col("__lo") * 0.5), None
    while True:
        size, width = state.filter("__lo < __hi").agg(F.max("__inside"), open_width).first()
        if (size or 0) <= group_rows or width == previous:  # small enough, or only repeats of the ends are left
            break
        state, previous = settle(_narrowed(cells, state, keys), "ranges"), width
    counted = _in_range(cells, state, keys).groupBy(*keys, "__v").agg(
        F.count(F.lit(1)).alias("__c"), F.max("__n").alias("__n"), F.max("__below").alias("__below")
    )
    counted = counted.withColumn("__upto", F.sum("__c").over(W.partitionBy(*keys).orderBy("__v")))

    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col("__upto") >= rank) & (F.col("__upto") - F.col("__c") < rank), F.col("__v")))

    first, last = _median_ranks()
    return counted.groupBy(*keys).agg(((value_at(first) + value_at(last)) / 2).alias(out))


def _largest(sizes: DataFrame, col: str) -> int:
    return sizes.agg(F.max(col)).first()[0] or 0


def exact_median(df: DataFrame, keys: list[str], value: str, out: str = "median",
                 group_rows: int = MEDIAN_GROUP_ROWS, largest: int | None = None) -> DataFrame:
    """Median per key without missing values; the route depends on the size of the largest group.

    ``largest`` is an upper bound the caller knows (such as the row count of a packed table); without it the
    groups are counted first.
    """
    clean = df.select(*keys, missing_to_null(F.col(value).cast("double")).alias("__v")).filter("__v is not null")
    if largest is None or largest > group_rows:
        state = _value_ranges(clean, keys)
        if _largest(state, "__n") > group_rows:
            return _narrow_from(clean, state, keys, out, group_rows)
    return clean.groupBy(*keys).agg(F.median("__v").alias(out))
