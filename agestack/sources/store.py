"""Artifacts as tables in one folder: models, features, dictionaries, out-of-fold rows, trials, settings."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import local_table


class ModelStore:
    """Each artifact is one Parquet table named after it; settings are one-row JSON tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, name: str, data: DataFrame | dict) -> str:
        if isinstance(data, dict):
            import json
            target = f"{self.path}/{name}.json"
            row = local_table(self.spark, [(json.dumps(data, sort_keys=True),)], "value string")
            row.coalesce(1).write.mode("overwrite").text(target)
        elif isinstance(data, DataFrame):
            target = f"{self.path}/{name}.parquet"
            data.write.mode("overwrite").parquet(target)
        else:
            raise TypeError(f"cannot store {type(data).__name__}")
        return target

    def load(self, name: str) -> DataFrame:
        """The named table; a name with extension is taken as it is, otherwise the known ones are tried."""
        tries = [name] if name.endswith((".parquet", ".csv")) else [f"{name}.parquet", f"{name}.csv"]
        for candidate in tries:
            reader = self.spark.read
            try:
                if candidate.endswith(".csv"):
                    return reader.option("header", True).csv(f"{self.path}/{candidate}")
                return reader.parquet(f"{self.path}/{candidate}")
            except AnalysisException as error:
                if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                    raise
        raise FileNotFoundError(f"no artifact {name} in {self.path}")

    def load_settings(self, name: str) -> dict:
        import json
        try:
            return json.loads(self.spark.read.text(f"{self.path}/{name}.json").first()["value"])
        except AnalysisException as error:
            raise FileNotFoundError(f"no artifact {name} in {self.path}") from error

    def save_models(self, stage: str, models: DataFrame, features: list[str]) -> None:
        """Packed models (``model_key, intercept, weights``) as a coefficient and an intercept table."""
        from ..operators.linear import coefficient_table

        self.save(f"{stage}_coefficients", coefficient_table(models, features, ["model_key"]).select(
            "model_key", "idx", "feature", "weight"))
        self.save(f"{stage}_intercepts", models.select("model_key", "intercept"))

    def save_fitted(self, stage: str, models: list[dict], features: list[str]) -> None:
        """The same for models that carry only the weights of the features they ``use``.

        Models with ``mean`` and ``scale`` are stored at unit scale: weights and intercept are those of the features less their
        mean, divided by their scale, and both are kept in ``<stage>_scaling``.
        """
        import numpy as np
        import pyarrow as pa

        from ..operators.align import feature_index

        uses = [np.arange(len(features)) if m["use"] is None else np.asarray(m["use"]) for m in models]
        keys = np.repeat(np.arange(len(models)), [len(u) for u in uses])
        cells = pa.table({
            "model": pa.array(keys, type=pa.int32()), "idx": pa.array(np.concatenate([*uses, []]).astype(np.int32)),
            "weight": pa.array(np.concatenate([*(np.asarray(m["weights"], dtype=float) * m.get("scale", 1.0) for m in models), []])),
            "mean": pa.array(np.concatenate([*(np.broadcast_to(m.get("mean", np.nan), len(u)) for m, u in zip(models, uses)), []])),
            "scale": pa.array(np.concatenate([*(np.broadcast_to(m.get("scale", np.nan), len(u)) for m, u in zip(models, uses)), []]))})
        names = pa.table({"model": pa.array(range(len(models)), type=pa.int32()),
                          "model_key": pa.array([m["model_key"] for m in models], type=pa.string()),
                          "intercept": pa.array([float(m["intercept"] + np.sum(m.get("mean", 0.0) * np.asarray(m["weights"], dtype=float)))
                                                 for m in models], type=pa.float64())})
        keyed = self.spark.createDataFrame(names)
        long = self.spark.createDataFrame(cells).join(keyed.select("model", "model_key"), "model").join(
            feature_index(self.spark, features), "idx")
        self.save(f"{stage}_coefficients", long.select("model_key", "idx", "feature", "weight"))
        self.save(f"{stage}_scaling", long.filter("not isnan(scale)").select("model_key", "idx", "feature", "mean", "scale"))
        self.save(f"{stage}_intercepts", keyed.select("model_key", "intercept"))

    def load_models(self, stage: str) -> DataFrame:
        """Packed models, weights in feature order.  The group of a model is bounded by its features."""
        ordered = F.array_sort(F.collect_list(F.struct("idx", "weight")))
        packed = self.load(f"{stage}_coefficients").groupBy("model_key").agg(ordered.alias("w")).select(
            "model_key", F.col("w.weight").alias("weights"), F.col("w.idx").alias("use"))
        return self.load(f"{stage}_intercepts").join(packed, "model_key")

    def load_fitted(self, stage: str) -> list[dict]:
        """The models on the driver, each with the positions its weights belong to; zeros stay in the store.

        Those stored at unit scale come back for the features as they are: weight / scale, and the intercept less what the
        means take.
        """
        from ..operators.linear import active

        import numpy as np

        models = {r["model_key"]: r.asDict() for r in self.load(f"{stage}_intercepts").collect()}
        stored = active(self.load(f"{stage}_coefficients")).select("model_key", "idx", "weight")
        try:
            scaling = self.load(f"{stage}_scaling").select("model_key", "idx", "mean", "scale")
        except FileNotFoundError:  # a store from before there was scaling
            scaling = None
        if scaling is not None and scaling.limit(1).count():
            folded = stored.join(scaling, ["model_key", "idx"], "left").withColumn(
                "weight", F.col("weight") / F.coalesce("scale", F.lit(1.0)))
            taken = folded.groupBy("model_key").agg(F.sum(F.col("weight") * F.coalesce("mean", F.lit(0.0))).alias("taken"))
            for r in taken.collect():
                models[r["model_key"]]["intercept"] -= r["taken"]
            stored = folded.select("model_key", "idx", "weight")
        cells = stored.toArrow()
        keys = cells.column("model_key").combine_chunks().dictionary_encode()
        codes = keys.indices.to_numpy(zero_copy_only=False) if len(cells) else np.zeros(0, dtype=int)
        idx, weight = cells.column("idx").to_numpy(), cells.column("weight").to_numpy()
        order = np.argsort(codes, kind="stable")
        bounds = np.searchsorted(codes[order], np.arange(len(keys.dictionary) + 1))
        at = {k: order[bounds[i]:bounds[i + 1]] for i, k in enumerate(keys.dictionary.to_pylist())}
        none = np.zeros(0, dtype=int)
        return [{**m, "use": idx[at.get(k, none)], "weights": weight[at.get(k, none)]} for k, m in models.items()]
