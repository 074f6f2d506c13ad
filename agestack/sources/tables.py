"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.align import melt_modality, pc_names
from ..operators.normalise import ensure_sample_id, repair_metadata_case

FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json"}


def _format_of(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    dot = name.rfind(".")
    return FORMATS.get(name[dot:].lower(), "csv") if dot > 0 else "parquet"


def load_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str | None = None) -> DataFrame:
    """Read a table, its format given or taken from the extension (no extension: Parquet, unknown: CSV)."""
    fmt = fmt or _format_of(path)
    if fmt not in FORMATS.values():
        raise ValueError(f"unknown table format {fmt!r}")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def read_modality(spark: SparkSession, path: str, modality: str) -> DataFrame:
    """A wide modality file as long cells."""
    return melt_modality(repair_metadata_case(ensure_sample_id(load_table(spark, path))), modality)


def read_context(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Context table: ids, tissue, and every ``RF_PC*`` column as double."""
    df = ensure_sample_id(load_table(spark, path, schema))
    pcs = pc_names(df.columns)
    kept = [c for c in ("sample_id", "Tissue") if c in df.columns]
    return df.select(*kept, *[F.col(c).cast("double").alias(c) for c in pcs])


def read_hallmarks(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """Hallmark dictionaries (JSON objects: hallmark -> list or object of sites) -> ``hallmark, pos, site``.

    One object per line, or one object per file with ``whole_file``.  Entries that are not text are skipped; ``pos`` is
    the place in the list or, among the keys, in the object as written.
    """
    lines = spark.read.option("wholetext", whole_file).text(path)
    return hallmark_map(lines.select("value"))


def hallmark_map(objects: DataFrame, col: str = "value") -> DataFrame:
    entries = objects.sparkSession.sql("""
        SELECT h.key AS hallmark, s.value AS entry, CASE WHEN s.key IS NULL THEN s.pos ELSE array_position(map_keys(
            from_json(element_at(from_json(object, 'map<string,string>'), h.key), 'map<string,string>')), s.key) - 1 END AS pos
        FROM {objects},
             LATERAL variant_explode(parse_json(object)) AS h,
             LATERAL variant_explode(h.value) AS s
    """, objects=objects.select(F.col(col).alias("object")))
    text = entries.filter("schema_of_variant(entry) = 'STRING'")
    return text.select("hallmark", F.col("pos").cast("int").alias("pos"), F.expr("variant_get(entry, '$', 'string')").alias("site"))


def save_predictions(df: DataFrame, path: str) -> str:
    """Write predictions as CSV with a header (a folder of part files), or Parquet by extension."""
    if _format_of(path) == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        df.write.mode("overwrite").option("header", True).csv(path)
    return path
