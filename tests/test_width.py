"""Very wide inputs: work in proportion to the width, and a Gram shuffle in proportion to rows times features."""

import time

import pytest
from pyspark.sql import functions as F

from agestack.operators import align, stats
from agestack.plans.assembly import assemble
from agestack.sources.store import ModelStore
from agestack.session import scratch_path


def test_packing_and_naming_are_linear(spark):
    p, n = 50_000, 8
    cells = spark.range(n * p).select(
        (F.col("id") % n).cast("string").alias("sample_id"), (F.col("id") / n).cast("int").alias("idx"), (F.col("id") % 97).cast("float").alias("value"))
    start = time.time()
    names = [f"f{i}" for i in range(p)]
    packed = align.pack_cells(cells.filter("idx % 10 <> 3"), p)
    back = align.unpack(packed, names)
    row = back.agg(F.count("value").alias("n"), F.count(F.lit(1)).alias("all"), F.count_if(F.col("feature") != F.concat(F.lit("f"), "idx")).alias("bad")).first()
    assert (row["n"], row["all"], row["bad"]) == (n * p * 9 // 10, n * p, 0)
    assert time.time() - start < 60


def test_models_are_stored_by_number(spark):
    store = ModelStore(spark, scratch_path(spark, "wide"))
    p = 30_000
    store.save_fitted("s", [{"model_key": "a", "intercept": 1.0, "use": None, "weights": [float(i % 7 == 0) for i in range(p)]},
                            {"model_key": "b", "intercept": 2.0, "use": [5], "weights": [3.0]}, {"model_key": "c", "intercept": 0.0, "use": [], "weights": []}],
                      [f"f{i}" for i in range(p)])
    got = {m["model_key"]: (m["intercept"], len(m["use"]), float(sum(m["weights"]))) for m in store.load_fitted("s")}
    assert got == {"a": (1.0, 4286, 4286.0), "b": (2.0, 1, 3.0), "c": (0.0, 0, 0.0)}


def test_bad_cells_are_refused(spark):
    for rows in ([("a", 0, 1.0), ("a", 0, 2.0)], [("a", 3, 1.0)], [("a", -1, 1.0)]):
        with pytest.raises(Exception, match="two cells|outside"):
            align.pack_cells(spark.createDataFrame(rows, "sample_id string, idx int, value double"), 3).collect()


@pytest.mark.parametrize("rows", [40, 4000])
def test_gram_shuffle_is_bounded(spark, rows):
    p, keys = 30, 3
    data = spark.range(rows, numPartitions=16).select(
        (F.col("id") % keys).alias("k"), F.transform(F.sequence(F.lit(1), F.lit(p)), lambda i: F.rand(1) * i).alias("values"), F.col("id").cast("double").alias("y"))
    emitted = stats.gram_parts(data, ["k"], p, "y").count()
    triangle = (p + 2) * (p + 3) // 2
    assert emitted <= (rows / (p + 2) + keys) * triangle <= rows * (p + 3) / 2 + keys * triangle


def test_assembly_without_any_feature(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    none = spark.createDataFrame([], "sample_id string, cg1 double")
    made = assemble(ids, {"beta": none})
    assert made.packed.count() == 0 and made.names() == []
    assert sorted(map(tuple, made.excluded.collect())) == [("a", "no features"), ("b", "no features")]
    known = spark.createDataFrame([(0, "cg1_beta")], "idx int, feature string")
    some = assemble(ids, {"beta": spark.createDataFrame([("a", None)], "sample_id string, cg1 double")}, features=known)
    assert [(r["sample_id"], r["values"]) for r in some.packed.collect()] == [("a", [None])]
    with pytest.raises(ValueError):
        assemble(ids.unionByName(ids), {"beta": none})
