"""Numbers and medians must equal those of the plain window and aggregate, whatever the skew."""

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from agestack.functions.scalar import seeded_hash
from agestack.operators import ranking


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one key, many repeated values."""
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 17).cast("string")))
    return spark.range(6000).select(key.alias("key"), F.col("id").cast("string").alias("sample_id"), "id",
                                    ((F.col("id") * 7919) % 101).alias("v")).cache()


def test_hash_rank(skewed):
    plain = skewed.withColumn("want", F.row_number().over(
        W.partitionBy("key").orderBy(seeded_hash(F.col("sample_id"), 5), "sample_id")))
    got = ranking.hash_rank(skewed, ["key"], "sample_id", 5)
    both = got.join(plain.select("sample_id", "want"), "sample_id")
    assert both.count() == 6000
    assert both.filter("rn <> want").count() == 0


@pytest.mark.parametrize("most", [0, 1, 37, 100000])
def test_hash_rank_at_most(skewed, most):
    full = ranking.hash_rank(skewed, ["key"], "sample_id", 5).filter(F.col("rn") <= most)
    cut = ranking.hash_rank(skewed, ["key"], "sample_id", 5, at_most=most)
    assert cut.select("sample_id", "rn").exceptAll(full.select("sample_id", "rn")).count() == 0
    assert cut.count() == full.count()


def test_strength_rank_with_ties(spark):
    df = spark.range(5000).select(
        F.lit("h").alias("hallmark"), F.col("id").alias("pos"),
        F.when(F.col("id") % 2 == 0, 0.0).otherwise((F.col("id") % 50) / 50).alias("r"))
    want = df.withColumn("want", F.row_number().over(W.partitionBy("hallmark").orderBy(F.desc("r"), "pos")))
    got = ranking.strength_rank(df, ["hallmark"], "r", "pos")
    assert got.join(want.select("pos", "want"), "pos").filter("rn <> want").count() == 0


def test_number_rows(spark):
    keys = spark.range(3000).select((F.col("id") * F.col("id") * 31).alias("k"))
    got = [r["n"] for r in ranking.number_rows(keys, ["k"], "n").orderBy("k").collect()]
    assert got == list(range(1, 3001))


@pytest.mark.parametrize("rows", [1, 20, 1000, 100000])
def test_narrowing_median(skewed, rows):
    got = {r["key"]: r["median"] for r in ranking.narrowing_median(skewed, ["key"], "v", group_rows=rows).collect()}
    want = {r["key"]: r["m"] for r in skewed.groupBy("key").agg(F.median("v").alias("m")).collect()}
    assert got == want


def test_median_ignores_missing(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", 1.0), ("a", 2.0), ("a", None), ("b", None)], "k string, v double")
    for rows in (0, 100):
        got = {r["k"]: r["median"] for r in ranking.exact_median(df, ["k"], "v", group_rows=rows).collect()}
        assert got == {"a": 1.5}


def test_medians_agree_with_numpy(spark):
    """Heavy tails, repeats, extremes and neighbours in the last bit."""
    rng = np.random.default_rng(1)
    sets = {
        "mixed": np.concatenate([rng.normal(size=501), np.full(700, 0.25), rng.exponential(1e6, size=300)]),
        "huge": np.concatenate([rng.normal(size=40), [1.7e308, -1.7e308]]),
        "close": np.nextafter(1.0, 2.0) + np.arange(40) * 2.3e-16,
        "gap": np.concatenate([np.full(50, -1.0), np.full(50, 1e9)]),
        "one": np.array([3.5]),
    }
    rows = [(k, float(v)) for k, vs in sets.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    for size in (1, 30):
        got = {r["k"]: r["median"] for r in ranking.narrowing_median(df, ["k"], "v", group_rows=size).collect()}
        assert got == {k: pytest.approx(float(np.median(v)), rel=1e-15) for k, v in sets.items()}


@pytest.mark.parametrize("rows", [0, 10000])
def test_median_of_the_whole_table(skewed, rows):
    got = ranking.exact_median(skewed, [], "v", group_rows=rows).first()["median"]
    assert got == skewed.agg(F.median("v")).first()[0]


@pytest.mark.parametrize("overstated", [1, 1000])
def test_hash_head_hashes_each_row_once(skewed, overstated):
    """The same rows and numbers as ``hash_rank``; a first cut that is too low (sizes overstated) is raised, not final."""
    most = 7
    want = ranking.hash_rank(skewed, ["key"], "sample_id", 5, at_most=most)
    sizes = skewed.groupBy("key").agg((F.count(F.lit(1)) * overstated).alias("n"))
    limits = sizes.withColumns({"most": F.lit(most), "seed": F.lit("5")})
    got = ranking.hash_head(skewed, ["key"], "sample_id", limits)
    columns = ["key", "sample_id", "rn"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_hash_head_leaves_out_other_keys(skewed):
    first = skewed.select("key").first()["key"]
    limits = skewed.filter(F.col("key") == first).groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumns({"most": F.lit(3), "seed": F.lit("5")})
    got = ranking.hash_head(skewed, ["key"], "sample_id", limits).collect()
    assert {r["key"] for r in got} == {first} and sorted(r["rn"] for r in got) == list(range(1, len(got) + 1))
