"""Queries: sources, sinks, stores, contracts, ids and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import site_name
from ..operators import contract, normalise
from ..operators.align import align_to_anchor, pc_names, unpack
from ..schema import SUFFIXES, modality_columns, pc_columns
from ..session import scratch_path, settle
from ..sources.files import file_trees
from ..sources.store import ModelStore
from ..sources.tables import load_table, read_context, read_hallmarks, read_modality, save_predictions
from ..sources.wide import read_packed
from . import standins as t
from .registry import query, rounded

CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("src1_load_table", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def src1(spark, sf):
    path = save_predictions(t.table(spark, sf, "customer"), scratch_path(spark, "customer") + ".csv")
    return load_table(spark, path, CUSTOMER)


@query("src2_read_modality", f"""WITH {t.CELLS_SQL}
SELECT sample_id, modality, feature, round(value, 6) + 0.0 AS value FROM cells WHERE modality = 'chalm'""")
def src2(spark, sf):
    path = save_predictions(t.wide_modality(spark, sf, "chalm"), scratch_path(spark, "chalm") + ".parquet")
    return read_modality(spark, path, "chalm").withColumn("value", rounded(F.col("value").cast("double")))


@query("src2_packed_files", f"""WITH {t.CELLS_SQL}, held AS (SELECT * FROM cells WHERE modality <> 'pc')
SELECT sample_id, modality, feature, CAST(dim % 20 AS INTEGER) AS idx, round(value, 6) + 0.0 AS value FROM held""")
def src2_packed(spark, sf):
    """All modality files by column tiles, a packed row per sample (and unpacked, to compare)."""
    parts = []
    for modality in SUFFIXES:
        path = save_predictions(t.wide_modality(spark, sf, modality), scratch_path(spark, modality) + ".parquet")
        made = read_packed(spark, path, modality)
        names = [r["feature"] for r in made.features.orderBy("idx").collect()]
        parts.append(unpack(made.packed, names).withColumn("modality", F.lit(modality)))
    cells = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return cells.select("sample_id", "modality", "feature", "idx", rounded(F.col("value").cast("double")).alias("value"))


@query("src3_read_context", f"""WITH {t.SAMPLES_SQL}
SELECT sample_id, "Tissue", round(CAST(embedding[61] AS DOUBLE), 6) + 0.0 AS "RF_PC1",
       round(CAST(embedding[62] AS DOUBLE), 6) + 0.0 AS "RF_PC2",
       round(CAST(embedding[63] AS DOUBLE), 6) + 0.0 AS "RF_PC3",
       round(CAST(embedding[64] AS DOUBLE), 6) + 0.0 AS "RF_PC4"
FROM samples""")
def src3(spark, sf):
    source = t.context(spark, sf).withColumnRenamed("sample_id", "Sample_ID")
    path = save_predictions(source, scratch_path(spark, "context") + ".csv")
    df = read_context(spark, path, source.schema)
    return df.withColumns({c: rounded(c) for c in pc_names(df.columns)})


@query("src4_hallmark_json", """
SELECT hallmark, site, CAST(row_number() OVER (PARTITION BY hallmark, chunk ORDER BY site) - (chunk % 2) AS INTEGER) AS pos
FROM (SELECT p_brand AS hallmark, 'cg' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS site, p_partkey // 500 AS chunk FROM part)""")
def src4(spark, sf):
    """Brands as hallmarks.  Objects carry at most 500 sites each: half as lists with a number to skip, half
    as nested objects, whose keys are not in their alphabetical order."""
    part = t.table(spark, sf, "part").withColumn("chunk", F.floor(F.col("p_partkey") / 500))
    quoted = F.collect_list(F.concat(F.lit('"'), site_name(F.col("p_partkey")), F.lit('"')))
    listed = part.groupBy("p_brand", "chunk").agg(F.array_sort(quoted).alias("sites"))
    as_list = F.concat(F.lit("[17,"), F.array_join("sites", ","), F.lit("]"))
    keyed = F.transform("sites", lambda s, i: F.concat(F.lit('"k'), (1000 - i).cast("string"), F.lit('":'), s))
    as_object = F.concat(F.lit("{"), F.array_join(keyed, ","), F.lit("}"))
    body = F.when(F.col("chunk") % 2 == 0, as_list).otherwise(as_object)
    path = scratch_path(spark, "hallmarks")
    listed.select(F.concat(F.lit('{"'), "p_brand", F.lit('":'), body, F.lit("}"))).write.text(path)
    return read_hallmarks(spark, path).select("hallmark", "site", "pos")


@query("src5_prediction_input", f"""WITH {t.PARTS_SQL}
SELECT CAST(p_partkey AS VARCHAR) AS sample_id, y AS age, yhat AS pred_age FROM parts""")
def src5(spark, sf):
    df = t.parts(spark, sf).select(F.col("p_partkey").cast("string").alias("sample_id"), F.col("y").alias("age"),
                                   F.col("yhat").alias("pred_age"))
    even = F.col("sample_id").cast("long") % 2 == 0
    csv = save_predictions(df.filter(even), scratch_path(spark, "input") + ".csv")
    parquet = save_predictions(df.filter(~even), scratch_path(spark, "input") + ".parquet")
    return load_table(spark, csv, df.schema).unionByName(load_table(spark, parquet))


@query("snk1_save_predictions", f"""WITH {t.PARTS_SQL}
SELECT CAST(p_partkey AS VARCHAR) AS sample_id, project_id, y AS age, yhat AS fused_age FROM parts""")
def snk1(spark, sf):
    df = t.parts(spark, sf).select(F.col("p_partkey").cast("string").alias("sample_id"), "project_id",
                                   F.col("y").alias("age"), F.col("yhat").alias("fused_age"))
    return load_table(spark, save_predictions(df, scratch_path(spark, "predictions") + ".csv"), df.schema)


def _store(spark) -> ModelStore:
    return ModelStore(spark, scratch_path(spark, "store"))


@query("snk2_oof_sinks", f"""WITH {t.PARTS_SQL}
SELECT CAST(p_partkey AS VARCHAR) AS sample_id, y AS age, yhat AS pred_age, project_id, p_brand AS "Tissue" FROM parts""")
def snk2(spark, sf):
    oof = t.parts(spark, sf).select(
        F.col("p_partkey").cast("string").alias("sample_id"), F.col("y").alias("age"), F.col("yhat").alias("pred_age"),
        "project_id", F.col("p_brand").alias("Tissue"))
    store = _store(spark)
    store.save("stage1_oof", oof)
    return store.load("stage1_oof")


@query("art1_store_save", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def art1(spark, sf):
    return spark.read.parquet(_store(spark).save("suppliers", t.table(spark, sf, "supplier")))


@query("art2_store_load", f"""WITH {t.CELLS_SQL}
SELECT feature, count(value) AS n FROM cells GROUP BY feature""")
def art2(spark, sf):
    """Saved by name, found again by name without extension."""
    store = _store(spark)
    store.save("feature_counts", t.cells(spark, sf).groupBy("feature").agg(F.count("value").alias("n")))
    return store.load("feature_counts")


@query("sch1_expected_columns", f"""WITH {t.CELLS_SQL}, counted AS (
  SELECT feature, count(value) AS n_values FROM cells GROUP BY feature), expected AS (
  SELECT 'cg' || lpad(CAST(i AS VARCHAR), 8, '0') || s AS feature
  FROM range(1, 1001) r(i), (VALUES ('_beta'), ('_chalm'), ('_camda')) m(s)
  UNION ALL SELECT 'RF_PC' || i FROM range(1, 21) r(i))
SELECT e.feature, coalesce(c.n_values, 0) AS n_values FROM expected e LEFT JOIN counted c USING (feature)""")
def sch1(spark, sf):
    """The expected column lists, each with the number of values the data holds for it."""
    names = [c for m in SUFFIXES for c in modality_columns(m)] + pc_columns()
    expected = spark.createDataFrame([(n,) for n in names], "feature string")
    counted = t.cells(spark, sf).groupBy("feature").agg(F.count("value").alias("n_values"))
    return expected.join(counted, "feature", "left").fillna(0, ["n_values"])


@query("con1_create_contract", f"""WITH {t.CELLS_SQL}
SELECT DISTINCT feature, 'float32' AS dtype FROM cells""")
def con1(spark, sf):
    return contract.contract_of(t.cells(spark, sf))


REQUIRED_SQL = """required AS (
  SELECT 'cg' || lpad(CAST(i AS VARCHAR), 8, '0') || s AS feature, CAST(i * 3 + m AS INTEGER) AS idx
  FROM range(0, 25) r(i), (VALUES ('_beta', 0), ('_chalm', 1), ('_camda', 2)) v(s, m))"""


def _required(spark):
    rows = [(f"cg{i:08d}{s}", i * 3 + m) for i in range(25) for m, s in enumerate(SUFFIXES.values())]
    return spark.createDataFrame(rows, "feature string, idx int")


@query("con2_validate_contract", f"""WITH {t.CELLS_SQL}, {REQUIRED_SQL}
SELECT feature, idx FROM required WHERE feature NOT IN (SELECT feature FROM cells WHERE value IS NOT NULL)""")
def con2(spark, sf):
    """Contract features for which the data has no value at all."""
    return contract.missing_features(_required(spark), t.cells(spark, sf).filter("value is not null"))


@query("con3_validate_master", f"""WITH {t.CELLS_SQL}, {REQUIRED_SQL}, gap AS (
  SELECT feature, idx FROM required WHERE feature NOT IN (SELECT feature FROM cells WHERE value IS NOT NULL))
SELECT feature, idx, (SELECT count(*) FROM gap) AS n_missing FROM gap ORDER BY idx LIMIT 5""")
def con3(spark, sf):
    present = settle(t.cells(spark, sf).filter("value is not null").select("feature").distinct())
    return contract.first_missing(_required(spark), present)


@query("con4_feature_width", """
SELECT count(*) AS n_rows, count(*) FILTER (len(embedding) <> 64) AS n_wrong, CAST(max(len(embedding)) AS INTEGER) AS width
FROM embeddings""")
def con4(spark, sf):
    return contract.width_report(t.packed(spark, sf), t.DIMS)


@query("nrm1_ensure_sample_id", "SELECT CAST(c_custkey AS VARCHAR) AS sample_id, c_mktsegment AS \"Tissue\" FROM customer")
def nrm1(spark, sf):
    df = t.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("Tissue"), F.col("c_custkey").alias("SAMPLE_ID"))
    return normalise.ensure_sample_id(df).select("sample_id", "Tissue")


@query("nrm2_generate_ids", """
SELECT 'sample_' || (row_number() OVER (ORDER BY o_orderkey) - 1) AS sample_id, o_orderkey FROM orders""")
def nrm2(spark, sf):
    return normalise.generate_ids(t.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey").select(
        "sample_id", "o_orderkey")


@query("nrm3_id_text", "SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, o_totalprice FROM orders")
def nrm3(spark, sf):
    df = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id"), "o_totalprice")
    return normalise.id_as_text(df)


@query("nrm4_metadata_case", f"""WITH {t.SAMPLES_SQL}
SELECT sample_id, project_id, "Tissue", "Age", "Sex", "Is_Healthy" FROM samples""")
def nrm4(spark, sf):
    lower = t.samples(spark, sf).withColumnsRenamed({"Age": "age", "Sex": "sex", "Is_Healthy": "is_healthy"})
    return normalise.repair_metadata_case(lower)


@query("nrm5_alias_metadata", f"""WITH {t.SAMPLES_SQL}
SELECT sample_id, "Age", "Tissue", 'Unknown' AS project_id FROM samples""")
def nrm5(spark, sf):
    """Age and tissue under alias names, no project column."""
    df = t.samples(spark, sf).withColumnsRenamed({"Age": "chronological_age", "Tissue": "source"}).drop("project_id")
    return normalise.resolve_metadata(df)


@query("nrm6_alias_prediction", f"""WITH {t.PARTS_SQL}
SELECT p_partkey, y AS age, yhat AS pred_age_stage1 FROM parts""")
def nrm6(spark, sf):
    df = t.parts(spark, sf).select("p_partkey", F.col("y").alias("Age"), F.col("yhat").alias("Global_Pred_Age"))
    return normalise.resolve_stage1_prediction(df)


@query("nrm7_expert_columns", """
SELECT l_orderkey, l_linenumber, l_quantity AS pred_resid_h1, l_discount AS pred_resid_h2 FROM lineitem""")
def nrm7(spark, sf):
    """Expert columns by prefix; the ensemble column is left out."""
    df = t.table(spark, sf, "lineitem").withColumnsRenamed({
        "l_quantity": "pred_resid_h1", "l_discount": "pred_resid_h2", "l_tax": "pred_resid_Global_Union"})
    return df.select("l_orderkey", "l_linenumber", *normalise.expert_columns(df.columns))


def _record_sql(columns: list[str]) -> str:
    fields = ", ".join(f"'{c}', {c}" for c in sorted(columns))
    return f"sha256(json_object({fields}))"


CUSTOMER_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
ORDERS_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _printed(df: DataFrame) -> DataFrame:
    """Doubles in whole cents, dates and times as text, so that both engines write the same JSON."""
    kinds = dict(df.dtypes)
    return df.select(*[
        F.round(F.col(c) * 100).cast("long").alias(c) if kinds[c] == "double"
        else F.col(c).cast("string").alias(c) if kinds[c].startswith(("date", "timestamp")) else F.col(c) for c in df.columns])


_CUSTOMER_ROWS = "SELECT * REPLACE (CAST(round(c_acctbal * 100) AS BIGINT) AS c_acctbal) FROM customer"
_ORDERS_ROWS = """SELECT * REPLACE (CAST(round(o_totalprice * 100) AS BIGINT) AS o_totalprice,
    CAST(o_orderdate AS VARCHAR) AS o_orderdate) FROM orders"""
_WORD_SUMS = " || ',' || ".join(
    f"CAST(sum(CAST('0x' || substr(digest, {8 * i + 1}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8))


@query("nrm8_record_fingerprint", f"SELECT c_custkey, {_record_sql(CUSTOMER_COLUMNS)} AS digest FROM ({_CUSTOMER_ROWS})")
def nrm8(spark, sf):
    return normalise.fingerprint(_printed(t.table(spark, sf, "customer"))).select("c_custkey", "digest")


@query("nrm8_table_digest", f"""
SELECT count(*) AS n_rows, {_WORD_SUMS} AS digest_sums
FROM (SELECT {_record_sql(ORDERS_COLUMNS)} AS digest FROM ({_ORDERS_ROWS}))""")
def nrm8_table(spark, sf):
    return normalise.table_digest(_printed(t.table(spark, sf, "orders")))


@query("nrm9_file_fingerprint", """
SELECT n_nationkey, 1 AS n_files, length(n_name) + 1 AS length, sha256(n_name || chr(10)) AS digest FROM nation""")
def nrm9(spark, sf):
    """One text file per nation, fingerprinted as files."""
    path = scratch_path(spark, "nations")
    names = t.table(spark, sf, "nation").select("n_name", "n_nationkey")
    names.repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    found = normalise.file_fingerprints(spark, path, "*.txt")
    key = F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int")
    return found.withColumn("n_nationkey", key).groupBy("n_nationkey").agg(
        F.count(F.lit(1)).cast("int").alias("n_files"), F.max("length").alias("length"), F.max("digest").alias("digest"))


def _tree_sql(levels: int = 6, range_bytes: int = 256, fan: int = 16) -> str:
    """Ranges of the files' bytes, and as many levels as any of the given tables needs: one node alone goes up unchanged."""
    steps = [f"""l{k + 1} AS (SELECT c_nationkey, length, n_ranges, pos // {fan} AS pos, CASE WHEN max(n) = 1 THEN max(digest)
  ELSE sha256(string_agg(digest, '' ORDER BY l{k}.pos)) END AS digest, (max(n) + {fan - 1}) // {fan} AS n
  FROM l{k} GROUP BY c_nationkey, length, n_ranges, l{k}.pos // {fan})""" for k in range(levels)]
    return f"""WITH files AS (SELECT c_nationkey, string_agg(c_name || '|' || c_custkey || chr(10), '' ORDER BY c_custkey) AS body
  FROM customer GROUP BY 1), cut AS (SELECT *, CAST((length(body) + {range_bytes - 1}) // {range_bytes} AS BIGINT) AS n FROM files),
l0 AS (SELECT c_nationkey, length(body) AS length, n AS n_ranges, pos, sha256(substr(body, pos * {range_bytes} + 1, {range_bytes})) AS digest, n
  FROM (SELECT *, unnest(range(0, n)) AS pos FROM cut)), {', '.join(steps)}
SELECT CAST(c_nationkey AS INTEGER) AS c_nationkey, length, n_ranges, digest FROM l{levels}"""


@query("nrm9_file_trees", _tree_sql())
def nrm9_trees(spark, sf):
    """One text file per nation with a line per customer, hashed by ranges of 256 bytes and a tree of 16 below one."""
    path = scratch_path(spark, "customers")
    lines = t.table(spark, sf, "customer").select("c_nationkey", "c_custkey", F.concat_ws("|", "c_name", "c_custkey").alias("line"))
    sorted_lines = lines.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").drop("c_custkey")
    sorted_lines.write.partitionBy("c_nationkey").text(path)
    found = file_trees(spark, path, "*.txt", 256, 16)
    key = F.regexp_extract("path", r"c_nationkey=(\d+)", 1).cast("int")
    return found.select(key.alias("c_nationkey"), "length", "n_ranges", "digest")


@query("jn2_align_to_anchor", """
SELECT CAST(d.doc_id AS VARCHAR) AS sample_id, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def jn2(spark, sf):
    anchor = t.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("sample_id"))
    labels = t.table(spark, sf, "labels").withColumn("sample_id", F.col("doc_id").cast("string")).drop("doc_id")
    return align_to_anchor(anchor, labels)


