"""The given tables seen as samples, features and hallmarks.

Every view is a pure expression over whole tables, so that an SQL engine can state the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schema import SUFFIXES
from ..session import local_table

DIMS = 64
FEATURES = [
    f"cg{d % 20:08d}{list(SUFFIXES.values())[d // 20]}" if d < 60 else f"RF_PC{d - 59}" for d in range(DIMS)
]
PCS = FEATURES[60:]
# Hallmark -> first and last site number; they overlap on purpose.
HALLMARK_SITES = {"H1": (0, 9), "H2": (5, 14), "H3": (8, 17)}

SAMPLES_SQL = """samples AS (
  SELECT vec_id, CAST(vec_id AS VARCHAR) AS sample_id, 'P' || (vec_id % 23) AS project_id, 'T' || label AS "Tissue",
         CAST((vec_id * 37) % 90 AS DOUBLE) AS "Age", CASE WHEN vec_id % 2 = 0 THEN 'F' ELSE 'M' END AS "Sex",
         vec_id % 10 <> 0 AS "Is_Healthy", embedding
  FROM embeddings)"""
CELLS_SQL = SAMPLES_SQL + """, dims AS (
  SELECT CAST(d AS INTEGER) AS dim,
         CASE WHEN d < 20 THEN 'beta' WHEN d < 40 THEN 'chalm' WHEN d < 60 THEN 'camda' ELSE 'pc' END AS modality,
         CASE WHEN d < 60 THEN 'cg' || lpad(CAST(d % 20 AS VARCHAR), 8, '0') ELSE 'RF_PC' || (d - 59) END AS site,
         CASE WHEN d < 60 THEN 'cg' || lpad(CAST(d % 20 AS VARCHAR), 8, '0') ELSE 'RF_PC' || (d - 59) END
           || CASE WHEN d < 20 THEN '_beta' WHEN d < 40 THEN '_chalm' WHEN d < 60 THEN '_camda' ELSE '' END AS feature
  FROM range(64) t(d)), cells AS (
  SELECT s.sample_id, s.project_id, s."Tissue", s."Age", s."Is_Healthy", d.dim, d.modality, d.site, d.feature,
         CASE WHEN (s.vec_id * 31 + d.dim * 17) % 11 = 0 OR d.dim = 19 THEN NULL
              ELSE CAST(s.embedding[d.dim + 1] AS DOUBLE) END AS value
  FROM samples s, dims d)"""
FILLED_SQL = CELLS_SQL + """, fills AS (
  SELECT feature, median(value) AS fill FROM cells GROUP BY feature), filled AS (
  SELECT c.* EXCLUDE (value), coalesce(c.value, f.fill, 0) AS value FROM cells c JOIN fills f USING (feature))"""
HALLMARKS_SQL = """hallmark_features AS (
  SELECT h.hallmark, (d.dim % 20 - h.lo) * 3 + d.dim // 20 AS pos, d.feature, d.dim
  FROM (VALUES ('H1', 0, 9), ('H2', 5, 14), ('H3', 8, 17)) h(hallmark, lo, hi)
  JOIN dims d ON d.dim < 60 AND d.dim % 20 BETWEEN h.lo AND h.hi)"""
Y_SQL = """CASE WHEN "Age" <= 20 THEN ln("Age" + 1) - ln(21) ELSE ("Age" - 20) / 21 END"""
PARTS_SQL = """parts AS (
  SELECT p_partkey, p_brand, p_type AS project_id, CAST(p_size AS DOUBLE) AS y,
         CAST(p_size + p_partkey % 7 - 3 AS DOUBLE) AS yhat FROM part)"""
ORDERS_SQL = """order_samples AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, c_mktsegment AS "Tissue", 'N' || c_nationkey AS project_id,
         o_totalprice, o_orderkey
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _meta(df: DataFrame) -> list[Column]:
    return [
        F.col("vec_id").cast("string").alias("sample_id"),
        F.concat(F.lit("P"), (F.col("vec_id") % 23).cast("string")).alias("project_id"),
        F.concat(F.lit("T"), F.col("label").cast("string")).alias("Tissue"),
        ((F.col("vec_id") * 37) % 90).cast("double").alias("Age"),
        F.when(F.col("vec_id") % 2 == 0, "F").otherwise("M").alias("Sex"),
        (F.col("vec_id") % 10 != 0).alias("Is_Healthy"),
    ]


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    return df.select(*_meta(df))


def _gap(vec_id: Column, dim: Column) -> Column:
    return ((vec_id * 31 + dim * 17) % 11 == 0) | (dim == 19)


def packed(spark: SparkSession, sf_dir: str, with_meta: bool = False) -> DataFrame:
    """``sample_id, values`` with NULL gaps (and the sample columns on request)."""
    df = table(spark, sf_dir, "embeddings")
    values = F.transform("embedding", lambda x, i: F.when(~_gap(F.col("vec_id"), i), x))
    meta = _meta(df) if with_meta else _meta(df)[:1]
    return df.select(*meta, values.alias("values"))


def cells(spark: SparkSession, sf_dir: str, with_meta: bool = False) -> DataFrame:
    """Long cells ``sample_id, modality, feature, value``; gaps are NULL."""
    df = table(spark, sf_dir, "embeddings")
    meta = _meta(df) if with_meta else _meta(df)[:1]
    long = df.select("vec_id", *meta, F.posexplode("embedding").alias("dim", "x"))
    names, mods = F.lit(FEATURES), F.lit(["beta", "chalm", "camda", "pc"])
    return long.select(
        *[c for c in long.columns if c not in ("vec_id", "x")],
        F.get(mods, F.floor(F.col("dim") / 20).cast("int")).alias("modality"),
        F.get(names, F.col("dim")).alias("feature"),
        F.when(~_gap(F.col("vec_id"), F.col("dim")), F.col("x")).alias("value"),
    )


def fills(spark: SparkSession, sf_dir: str) -> list[float]:
    """Median of every column, 0 where there is no value."""
    from ..operators.impute import packed_fills

    return packed_fills(packed(spark, sf_dir), DIMS)


def wide_modality(spark: SparkSession, sf_dir: str, modality: str) -> DataFrame:
    """One modality as a wide table with bare site names and the sample columns."""
    start = list(SUFFIXES).index(modality) * 20
    df = packed(spark, sf_dir, with_meta=True)
    sites = [F.get("values", F.lit(start + i)).alias(f"cg{i:08d}") for i in range(20)]
    return df.select("sample_id", "project_id", "Tissue", "Age", "Sex", "Is_Healthy", *sites)


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample_id, Tissue, RF_PC1..4``; here every component is filled."""
    df = table(spark, sf_dir, "embeddings")
    pcs = [F.get("embedding", F.lit(60 + i)).cast("double").alias(f"RF_PC{i + 1}") for i in range(4)]
    return df.select(*_meta(df)[:1], _meta(df)[2], *pcs)


def gappy_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample_id, RF_PC1..4`` with the gaps of the packed rows."""
    df = packed(spark, sf_dir)
    return df.select("sample_id", *[F.get("values", F.lit(60 + i)).alias(f"RF_PC{i + 1}") for i in range(4)])


def feature_index(spark: SparkSession) -> DataFrame:
    return local_table(spark, list(enumerate(FEATURES)), "idx int, feature string")


def hallmark_sites(spark: SparkSession) -> DataFrame:
    rows = [(h, i - lo, f"cg{i:08d}") for h, (lo, hi) in HALLMARK_SITES.items() for i in range(lo, hi + 1)]
    return local_table(spark, rows, "hallmark string, pos int, site string")


def hallmark_features(spark: SparkSession) -> DataFrame:
    from ..operators.align import expand_over_modalities

    return expand_over_modalities(hallmark_sites(spark), feature_index(spark))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions: age = p_size, guess = age + (key mod 7) - 3."""
    df = table(spark, sf_dir, "part")
    return df.select(
        "p_partkey", "p_brand", F.col("p_type").alias("project_id"), F.col("p_size").cast("double").alias("y"),
        (F.col("p_size") + F.col("p_partkey") % 7 - 3).cast("double").alias("yhat"),
    )


def order_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as samples: customer segment = tissue, nation = project."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("string").alias("sample_id"), F.col("c_mktsegment").alias("Tissue"),
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("project_id"), "o_totalprice", "o_orderkey",
    )
