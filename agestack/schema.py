"""Names and types of the tables this package reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

# Metadata columns, modality suffixes, column prefixes and alias lists of the data contract.
METADATA = ["sample_id", "project_id", "Tissue", "Age", "Sex", "Is_Healthy"]
NOT_FEATURES = ["sample_id", "project_id", "Tissue", "Age", "age", "Sex", "Is_Healthy", "Sex_encoded"]
SUFFIXES = {"beta": "_beta", "chalm": "_chalm", "camda": "_camda"}
PC_PREFIX = "RF_PC"
TISSUE_PREFIX = "Tissue_"
EXPERT_PREFIX = "pred_resid_"
EXPERT_FALLBACK_PREFIX = "pred_age_"
ENSEMBLE_MARK = "Global_Union"
STAGE1_PRED = "pred_age_stage1"
STAGE1_PRED_ALIASES = ["pred_age_stage1", "Stage1_Pred", "pred_age", "Global_Pred_Age"]
AGE_ALIASES = ["Age", "age", "True_Age", "chronological_age"]
TISSUE_ALIASES = ["Tissue", "tissue", "Source", "source"]
N_SITES = 1000
N_PCS = 20

METADATA_SCHEMA = T.StructType([
    T.StructField("sample_id", T.StringType()),
    T.StructField("project_id", T.StringType()),
    T.StructField("Tissue", T.StringType()),
    T.StructField("Age", T.DoubleType()),
    T.StructField("Sex", T.StringType()),
    T.StructField("Is_Healthy", T.BooleanType()),
])

CELL_SCHEMA = T.StructType([
    T.StructField("sample_id", T.StringType()),
    T.StructField("modality", T.StringType()),
    T.StructField("feature", T.StringType()),
    T.StructField("value", T.FloatType()),
])


def site_names(n: int = N_SITES) -> list[str]:
    return [f"cg{i:08d}" for i in range(1, n + 1)]


def modality_columns(modality: str, n: int = N_SITES) -> list[str]:
    return [site + SUFFIXES[modality] for site in site_names(n)]


def pc_columns(n: int = N_PCS) -> list[str]:
    return [f"{PC_PREFIX}{i}" for i in range(1, n + 1)]


def contract_schema(columns: list[str]) -> T.StructType:
    """The contract of a feature table: every column is a 32-bit float."""
    return T.StructType([T.StructField(c, T.FloatType()) for c in columns])
