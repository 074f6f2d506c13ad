"""Checks that a table carries what a model needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

SHOWN = 5


def contract_of(features: DataFrame) -> DataFrame:
    """The contract of a long table: every feature is a 32-bit float."""
    return features.select("feature").distinct().withColumn("dtype", F.lit("float32"))


def missing_columns(columns: list[str], contract: T.StructType) -> list[str]:
    present = set(columns)
    return [f.name for f in contract.fields if f.name not in present]


def validate_contract(columns: list[str], contract: T.StructType) -> bool:
    return not missing_columns(columns, contract)


def missing_features(required: DataFrame, present: DataFrame) -> DataFrame:
    """Required features that a long table lacks."""
    return required.join(present.select("feature").distinct(), "feature", "left_anti")


def first_missing(required: DataFrame, present: DataFrame, shown: int = SHOWN) -> DataFrame:
    """The first missing features in model order with the total number missing (empty when none is)."""
    gap = missing_features(required, present)
    total = gap.agg(F.count(F.lit(1)).alias("n_missing")).first()[0]
    return gap.orderBy("idx").limit(shown).withColumn("n_missing", F.lit(total).cast("long"))


def validate_master_table(df: DataFrame, required: list[str] | None = None) -> None:
    if "sample_id" not in df.columns:
        raise ValueError("master table lacks metadata columns: ['sample_id']")
    missing = [c for c in required or [] if c not in df.columns]
    if missing:
        raise ValueError(f"master table lacks {len(missing)} required features: {missing[:SHOWN]}")


def width_report(packed: DataFrame, n_features: int) -> DataFrame:
    """Rows whose packed width differs from the number of feature names."""
    wrong = F.col("values").isNull() | (F.size("values") != n_features)
    return packed.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(wrong).alias("n_wrong"), F.max(F.size("values")).alias("width")
    )


def require_width(packed: DataFrame, n_features: int) -> None:
    n_wrong = width_report(packed, n_features).first()["n_wrong"]
    if n_wrong:
        raise ValueError(f"{n_wrong} rows do not carry {n_features} features")


def duplicate_ids(df: DataFrame, key: str = "sample_id") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def require_unique(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """Joins multiply rows on repeated ids without a word, so refuse them first."""
    bad = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(key).isNull())
    repeated = bad.orderBy(F.col(key).asc_nulls_first()).limit(SHOWN).collect()  # sorted, so that all tasks run at once
    if repeated and repeated[0][key] is None:
        raise ValueError(f"{key} has missing values")
    if repeated:
        raise ValueError(f"{key} repeats: {[r[key] for r in repeated]}")
    return df
