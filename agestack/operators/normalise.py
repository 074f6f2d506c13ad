"""Ids, metadata names and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schema import (
    AGE_ALIASES, ENSEMBLE_MARK, EXPERT_FALLBACK_PREFIX, EXPERT_PREFIX, METADATA, STAGE1_PRED,
    STAGE1_PRED_ALIASES, TISSUE_ALIASES,
)
from .ranking import number_rows


def ensure_sample_id(df: DataFrame, id_col: str | None = None) -> DataFrame:
    """Rename the id column whatever its case; else ``id_col``; else the first column.  Ids become text."""
    if "sample_id" not in df.columns:
        same = [c for c in df.columns if c.lower() == "sample_id"]
        df = df.withColumnRenamed(same[0] if same else id_col or df.columns[0], "sample_id")
    return id_as_text(df)


def id_as_text(df: DataFrame, col: str = "sample_id") -> DataFrame:
    return df.withColumn(col, F.col(col).cast("string"))


def generate_ids(df: DataFrame, key: str) -> DataFrame:
    """Give ``sample_0, sample_1, ...`` in the order of a key, spread over all tasks."""
    if "sample_id" in df.columns:
        return df
    numbered = number_rows(df, [key], "__i")
    return numbered.withColumn("sample_id", F.concat(F.lit("sample_"), (F.col("__i") - 1).cast("string"))).drop("__i")


def repair_metadata_case(df: DataFrame) -> DataFrame:
    lower = {name.lower(): name for name in METADATA}
    return df.withColumnsRenamed({
        c: lower[c] for c in df.columns if c in lower and lower[c] not in df.columns
    })


def _first_present(df: DataFrame, aliases: list[str]) -> str | None:
    return next((c for c in aliases if c in df.columns), None)


def resolve_metadata(df: DataFrame) -> DataFrame:
    """``sample_id, Age, Tissue, project_id`` from the first alias column that exists."""
    age, tissue = _first_present(df, AGE_ALIASES), _first_present(df, TISSUE_ALIASES)
    return df.select(
        "sample_id",
        (F.col(age).cast("double") if age else F.lit(None).cast("double")).alias("Age"),
        (F.col(tissue) if tissue else F.lit("Unknown")).alias("Tissue"),
        (F.col("project_id") if "project_id" in df.columns else F.lit("Unknown")).alias("project_id"),
    )


def resolve_stage1_prediction(df: DataFrame, strict: bool = True) -> DataFrame:
    """Find the stage-1 prediction under its known names; training is strict, scoring knows two aliases."""
    names = STAGE1_PRED_ALIASES if strict else STAGE1_PRED_ALIASES[:3]
    found = _first_present(df, names)
    if found is None:
        if strict:
            raise KeyError(f"no stage-1 prediction among {df.columns}")
        return df
    df = df.withColumnRenamed(found, STAGE1_PRED)
    if strict and "age" not in df.columns and "Age" in df.columns:
        df = df.withColumnRenamed("Age", "age")
    return df


def expert_columns(columns: list[str]) -> list[str]:
    known = {"sample_id", "age", "Tissue", "project_id", STAGE1_PRED}
    found = (
        [c for c in columns if c.startswith(EXPERT_PREFIX)]
        or [c for c in columns if c.startswith(EXPERT_FALLBACK_PREFIX) and c != STAGE1_PRED]
        or [c for c in columns if c not in known]
    )
    return [c for c in found if ENSEMBLE_MARK not in c]


def fingerprint(df: DataFrame, out: str = "digest") -> DataFrame:
    """sha256 of each record as JSON with its fields in name order."""
    fields = F.struct(*[F.col(c) for c in sorted(df.columns)])
    return df.withColumn(out, F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256))


def table_digest(df: DataFrame) -> DataFrame:
    """One digest per table that does not depend on row order: the sums of each 32-bit word of the record fingerprints.

    The eight sums are decimals of 38 digits, which no number of rows overflows.
    """
    words = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)") for i in range(8)]
    sums = [F.sum(w).cast("string") for w in words]
    return fingerprint(df).agg(F.count(F.lit(1)).alias("n_rows"), F.concat_ws(",", *[F.coalesce(s, F.lit("0")) for s in sums]).alias("digest_sums"))


def file_fingerprints(spark, path: str, pattern: str = "*") -> DataFrame:
    """sha256 of every file below a folder, one file per row (Spark reads files up to 2 GB this way)."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("digest")
    )
