"""A family joined to rows of which nine tenths have one tissue."""

import pytest
from pyspark.sql import functions as F

from agestack.operators import score


@pytest.fixture
def plain_joins(spark):
    """No broadcast and no regrouping of partitions, so that a task's rows are those of its keys."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def _rows(spark, n):
    tissue = F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 == 0, F.concat(F.lit("T"), (F.col("id") % 7).cast("string")))
    return spark.range(n, numPartitions=8).select(
        F.col("id").cast("string").alias("sample_id"), tissue.alias("Tissue"), F.array(F.col("id").cast("double"), F.lit(2.0)).alias("values"))


def test_hot_tissue_is_spread(plain_joins):
    spark, n = plain_joins, 8000
    df = _rows(spark, n)
    models = spark.createDataFrame([("hot", 1.0, [1.0, 0.5]), ("T1", -3.0, [0.0, 1.0]), ("T9", 9.0, [9.0, 9.0]), ("Global", 0.25, [0.5, 0.0])],
                                   "model_key string, intercept double, weights array<double>")
    got = score.score_with_fallback(df, models, rows_per_salt=100)
    per_task = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == n and max(per_task) < 0.2 * n
    alone = score.score_with_fallback(df, models, rows_per_salt=n)
    assert max(r["count"] for r in alone.groupBy(F.spark_partition_id()).count().collect()) >= 0.9 * n
    assert got.columns == alone.columns
    assert got.exceptAll(alone).count() == 0 and got.count() == alone.count() == n
    want = F.when(F.col("Tissue") == "hot", 2.0 + F.col("sample_id").cast("double")).when(F.col("Tissue") == "T1", -1.0).otherwise(
        0.25 + 0.5 * F.col("sample_id").cast("double"))
    assert got.filter(F.abs(F.col("correction") - want) > 1e-9).count() == 0


def test_copies_only_where_asked_for(spark):
    keyed = _rows(spark, 1000).withColumn("model_key", F.coalesce("Tissue", F.lit("Global")))
    models = spark.createDataFrame([("hot", 0.0), ("T1", 0.0), ("unused", 0.0)], "model_key string, intercept double")
    rows, copies = score.salted_models(keyed, models, 300)
    assert {r["model_key"]: r["count"] for r in copies.groupBy("model_key").count().collect()} == {"hot": 3, "T1": 1, "unused": 1}
    assert rows.count() == 1000 and {r["__salt"] for r in rows.filter("model_key <> 'hot'").select("__salt").collect()} == {0}


def test_rows_without_ids_nulls_and_no_models(spark):
    df = spark.createDataFrame([(None, [1.0]), ("a", [2.0]), ("a", [2.0]), ("b", None)], "Tissue string, values array<double>")
    none = spark.createDataFrame([], "model_key string, intercept double, weights array<double>")
    assert [r["correction"] for r in score.score_with_fallback(df, none, rows_per_salt=1).collect()] == [0.0] * 4
    own = spark.createDataFrame([("a", 1.0, [3.0])], none.schema)
    assert sorted(r["correction"] for r in score.score_with_fallback(df, own, rows_per_salt=1).collect()) == [0.0, 0.0, 7.0, 7.0]
