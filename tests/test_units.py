"""Scalars, contracts, names, sources, stores."""

import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from agestack import schema
from agestack.functions.metrics import micro_macro_mae, regression_metrics
from agestack.functions.scalar import AGE_TARGET, standardize, strip_prefix, with_suffix
from agestack.operators import align, contract, impute, normalise
from agestack.session import scratch_path
from agestack.sources.store import ModelStore
from agestack.sources.tables import hallmark_map, load_table, save_predictions


def test_age_transform_round_trip(spark):
    ages = [0.0, 0.5, 19.999, 20.0, 20.001, 55.0, 120.0]
    df = spark.createDataFrame([(a,) for a in ages], "age double").withColumn("y", AGE_TARGET.forward(F.col("age")))
    for r in df.withColumn("back", AGE_TARGET.inverse(F.col("y"))).collect():
        want = math.log(r["age"] + 1) - math.log(21) if r["age"] <= 20 else (r["age"] - 20) / 21
        assert r["y"] == pytest.approx(want)
        assert r["back"] == pytest.approx(r["age"])
        assert float(AGE_TARGET.inverse_array(np.array([r["y"]]))[0]) == pytest.approx(r["age"])


def test_undefined_age_is_null(spark):
    df = spark.createDataFrame([(-1.0,), (-3.0,), (None,)], "age double")
    assert [r[0] for r in df.select(AGE_TARGET.forward(F.col("age"))).collect()] == [None] * 3


@settings(max_examples=50, deadline=None)
@given(st.floats(-0.99, 150))
def test_age_arrays(age):
    y = math.log(age + 1) - math.log(21) if age <= 20 else (age - 20) / 21
    assert float(AGE_TARGET.inverse_array(np.array([y]))[0]) == pytest.approx(age, abs=1e-9)


def test_names(spark):
    row = spark.range(1).select(
        with_suffix(F.lit("cg1"), F.lit("_beta")).alias("a"), with_suffix(F.lit("cg1_beta"), F.lit("_beta")).alias("b"),
        strip_prefix(F.lit("Tissue_Skin"), "Tissue_").alias("c"), strip_prefix(F.lit("Skin"), "Tissue_").alias("d"),
        standardize(F.lit(3.0), F.lit(1.0), F.lit(0.0)).alias("e")).first()
    assert tuple(row) == ("cg1_beta", "cg1_beta", "Skin", "Skin", 2.0)


def test_schema_lists():
    assert schema.site_names()[0] == "cg00000001" and len(schema.site_names()) == 1000
    assert schema.modality_columns("camda")[-1] == "cg00001000_camda"
    assert schema.pc_columns()[-1] == "RF_PC20"
    assert contract.missing_columns(["a"], schema.contract_schema(["a", "b"])) == ["b"]
    assert contract.validate_contract(["a", "b"], schema.contract_schema(["a"]))


def test_master_table(spark):
    good = spark.createDataFrame([(1, "Blood", "M", 0.1, 0.2, 0.3)], ["sample_id", "Tissue", "Sex", "RF_PC1", "RF_PC2", "cg00000029_beta"])
    contract.validate_master_table(good, ["RF_PC1", "cg00000029_beta"])
    with pytest.raises(ValueError, match="1 required"):
        contract.validate_master_table(good.drop("cg00000029_beta"), ["RF_PC1", "cg00000029_beta"])
    with pytest.raises(ValueError, match="sample_id"):
        contract.validate_master_table(good.drop("sample_id"))


def test_bad_ids_are_refused(spark):
    anchor = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    twice = spark.createDataFrame([("a", 1), ("a", 2)], "sample_id string, v int")
    with pytest.raises(ValueError, match="repeats"):
        align.align_to_anchor(anchor, twice)
    with pytest.raises(ValueError, match="missing"):
        contract.require_unique(spark.createDataFrame([(None, 1)], "sample_id string, v int"))
    with pytest.raises(ValueError, match="carry"):
        contract.require_width(spark.createDataFrame([("a", [1.0])], "sample_id string, values array<double>"), 2)


def test_id_column_rules(spark):
    def ids(cols, **kw):
        return normalise.ensure_sample_id(spark.createDataFrame([(1, 2)], cols), **kw).columns
    assert ids(["x", "Sample_ID"]) == ["x", "sample_id"]
    assert ids(["x", "y"]) == ["sample_id", "y"]
    assert ids(["x", "y"], id_col="y") == ["x", "sample_id"]


def test_alias_rules(spark):
    df = spark.createDataFrame([("s", 30.0, "Skin")], ["sample_id", "age", "source"])
    assert normalise.resolve_metadata(df).first().asDict() == {"sample_id": "s", "Age": 30.0, "Tissue": "Skin", "project_id": "Unknown"}
    bare = normalise.resolve_metadata(df.select("sample_id")).first()
    assert bare["Age"] is None and bare["Tissue"] == "Unknown"
    with pytest.raises(KeyError):
        normalise.resolve_stage1_prediction(df)
    assert normalise.resolve_stage1_prediction(df, strict=False).columns == df.columns
    # The scoring side does not know the last alias.
    late = df.withColumnRenamed("age", "Global_Pred_Age")
    assert "pred_age_stage1" not in normalise.resolve_stage1_prediction(late, strict=False).columns
    assert "pred_age_stage1" in normalise.resolve_stage1_prediction(late).columns


def test_expert_column_rules():
    assert normalise.expert_columns(["sample_id", "pred_resid_A", "pred_resid_Global_Union", "pred_age_B"]) == ["pred_resid_A"]
    assert normalise.expert_columns(["sample_id", "pred_age_stage1", "pred_age_B"]) == ["pred_age_B"]
    assert normalise.expert_columns(["sample_id", "age", "Tissue", "project_id", "A", "X_Global_Union"]) == ["A"]


def test_melt_drops_text_and_nan(spark):
    wide = spark.createDataFrame([("a", "x", 30.0, 0.5, float("nan"), "t")], ["sample_id", "Tissue", "Age", "cg1", "cg2_beta", "note"])
    got = {r["feature"]: r["value"] for r in align.melt_modality(wide, "beta").collect()}
    assert got == {"cg1_beta": 0.5, "cg2_beta": None}


def test_filter_and_impute(spark):
    df = spark.createDataFrame([("a", 1.0, None, 30.0), ("b", None, None, 40.0), ("c", 4.0, None, None)],
                               "sample_id string, f double, g double, Age double")
    for strategy, want in (("median", 2.5), ("mean", 2.5), ("zero", 0.0)):
        for rows in (0, 100):
            got = {r["sample_id"]: r for r in impute.filter_and_impute(df, strategy, rows).collect()}
            assert got["b"]["f"] == want and got["b"]["g"] == 0.0 and got["c"]["Age"] is None


def test_packed_fills(spark):
    df = spark.createDataFrame([([1.0, None, 2.0],), ([3.0, None, 4.0],), ([8.0, None, None],)], "values array<float>")
    assert impute.packed_fills(df, 3) == [3.0, 0.0, 3.0]
    assert impute.packed_fills(df, 3, "mean") == [4.0, 0.0, 3.0]


def test_packing_round_trip(spark):
    cells = spark.createDataFrame([("a", 0, 1.0), ("a", 2, 3.0), ("b", 1, 2.0)], "sample_id string, idx int, value float")
    got = {r["sample_id"]: r["values"] for r in align.pack_cells(cells, 3).collect()}
    assert got == {"a": [1.0, None, 3.0], "b": [None, 2.0, None]}


def test_align_columns(spark):
    df = spark.createDataFrame([("a", "Skin", 1.5)], ["sample_id", "Tissue", "RF_PC1"])
    packed = align.pack_columns(df, ["RF_PC1", "RF_PC2", "Tissue_Skin", "Tissue_Blood"])
    assert packed.first()["values"] == [1.5, 0.0, 1.0, 0.0]
    assert align.pack_columns(df.drop("Tissue"), ["Tissue_Skin"]).first()["values"] == [0.0]


def test_hallmark_shapes(spark):
    objects = spark.createDataFrame([('{"A": ["s1", 7, "s2"], "B": {"k": "s3", "n": 1}, "C": []}',)], "value string")
    got = sorted((r["hallmark"], r["pos"], r["site"]) for r in hallmark_map(objects).collect())
    assert got == [("A", 0, "s1"), ("A", 2, "s2"), ("B", 0, "s3")]


def test_metrics_edges(spark):
    df = spark.createDataFrame([("one", 3.0, 4.0), ("flat", 1.0, 2.0), ("flat", 3.0, 2.0), ("same", 5.0, 5.0), ("same", 5.0, 5.0)],
                               "k string, y double, yhat double")
    got = {r["k"]: r for r in regression_metrics(df, ["k"]).collect()}
    assert got["one"]["PearsonR"] == 0 and got["one"]["MedianAE"] == 1
    assert got["flat"]["PearsonR"] == 0 and got["flat"]["R2"] == 0
    assert got["same"]["R2"] == 1 and got["same"]["MAE"] == 0
    row = micro_macro_mae(df, "k").first()
    assert row["micro_mae"] == pytest.approx(3 / 5) and row["macro_mae"] == pytest.approx(2 / 3)


def test_sources(spark):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "sample_id string, v double")
    for ext in (".csv", ".parquet"):
        path = save_predictions(df, scratch_path(spark, "t") + ext)
        assert sorted(load_table(spark, path, df.schema).collect()) == sorted(df.collect())
    with pytest.raises(ValueError):
        load_table(spark, "/nowhere", fmt="pickle")


def test_store(spark):
    store = ModelStore(spark, scratch_path(spark, "store"))
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    store.save("t", df)
    assert store.load("t").collect() == df.collect() == store.load("t.parquet").collect()
    store.save("s", {"pcs": ["RF_PC1"], "alpha": 2.0})
    assert store.load_settings("s") == {"pcs": ["RF_PC1"], "alpha": 2.0}
    save_predictions(df, store.path + "/plain.csv")
    assert store.load("plain").columns == ["a", "b"]
    with pytest.raises(FileNotFoundError):
        store.load("missing")
    with pytest.raises(FileNotFoundError):
        store.load_settings("missing")
    with pytest.raises(TypeError):
        store.save("x", 5)


def test_store_models(spark):
    store = ModelStore(spark, scratch_path(spark, "store"))
    store.save_fitted("m", [{"model_key": "A", "intercept": 1.0, "use": (2, 0), "weights": [0.5, 0.0]},
                            {"model_key": "B", "intercept": 2.0, "use": None, "weights": [1.0, 2.0, 3.0]}], ["f", "g", "h"])
    back = {m["model_key"]: m for m in store.load_fitted("m")}
    assert back["A"]["use"] == [2] and back["A"]["weights"] == [0.5]
    assert dict(zip(back["B"]["use"], back["B"]["weights"])) == {0: 1.0, 1: 2.0, 2: 3.0}


def test_fingerprints(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    assert normalise.table_digest(a).first() == normalise.table_digest(a.orderBy(F.desc("a")).select("b", "a")).first()
    assert normalise.table_digest(a).first() != normalise.table_digest(a.filter("a = 1")).first()
