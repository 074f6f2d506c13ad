"""From modality tables to aligned cells: unpivot, suffix, align to the anchor, project, join, pack."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.scalar import fill_missing, missing_to_null, strip_prefix, with_suffix
from ..schema import EXPERT_PREFIX, NOT_FEATURES, PC_PREFIX, STAGE1_PRED, SUFFIXES, TISSUE_PREFIX
from .contract import require_unique

#: Packed numbers that one Arrow batch holds.
BATCH_NUMBERS = 4 << 20
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are not metadata."""
    return [f.name for f in df.schema.fields if f.name not in NOT_FEATURES and isinstance(f.dataType, _NUMERIC)]


def to_float32(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.col(c).cast("float") for c in doubles})


def suffix_features(cells: DataFrame, modality: str) -> DataFrame:
    suffix = F.lit(SUFFIXES.get(modality, ""))
    return cells.withColumn("feature", with_suffix(F.col("feature"), suffix))


def melt_modality(wide: DataFrame, modality: str) -> DataFrame:
    """Wide modality table -> long cells; NaN becomes NULL, names get the modality suffix."""
    names = feature_columns(wide)
    floats = wide.select("sample_id", *[missing_to_null(F.col(c).cast("float")).alias(c) for c in names])
    cells = floats.unpivot(["sample_id"], names, "feature", "value")
    cells = cells.withColumn("modality", F.lit(modality))
    return suffix_features(cells, modality).select("sample_id", "modality", "feature", "value")


def stack_modalities(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def drop_overlap(left: DataFrame, right: DataFrame, key: str = "sample_id") -> DataFrame:
    """The right side without the columns the left side already has."""
    return right.drop(*[c for c in right.columns if c in left.columns and c != key])


def join_modalities(base: DataFrame, *parts: DataFrame | None) -> DataFrame:
    """Inner-join wide modality tables one after the other; the left side wins on shared names."""
    out = base
    for part in parts:
        if part is not None and part is not base:
            out = out.join(drop_overlap(out, part), "sample_id", "inner")
    return out


def complete_samples(cells: DataFrame, n_modalities: int) -> DataFrame:
    """The inner join in long form: samples that occur in every modality."""
    return (
        cells.select("sample_id", "modality").distinct()
        .groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") == n_modalities).select("sample_id")
    )


def anchor_ids(context: DataFrame) -> DataFrame:
    return context.select(F.col("sample_id").cast("string").alias("sample_id")).distinct()


def align_to_anchor(anchor: DataFrame, table: DataFrame, checked: bool = True) -> DataFrame:
    """One row per anchor id; ids the table lacks become all-missing rows.  Repeated ids are refused."""
    if checked:
        require_unique(table)
    return anchor.join(table, "sample_id", "left")


def coverage(anchor: DataFrame, cells: DataFrame) -> DataFrame:
    """Anchor ids present per modality."""
    present = cells.select("sample_id", "modality").distinct()
    return (
        present.join(anchor, "sample_id", "left_semi")
        .groupBy("modality").agg(F.count(F.lit(1)).alias("n_present"))
    )


def absent_ids(anchor: DataFrame, table: DataFrame) -> DataFrame:
    return anchor.join(table.select("sample_id"), "sample_id", "left_anti")


def keep_features(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    return cells.join(wanted.select("feature"), "feature", "left_semi")


def select_features(wide: DataFrame, wanted: list[str]) -> DataFrame:
    """Metadata plus the wanted features that exist."""
    meta = [c for c in NOT_FEATURES if c in wide.columns and c != "Age"]
    return wide.select(*meta, *[c for c in wanted if c in wide.columns and c not in meta])


def expand_over_modalities(hallmark_map: DataFrame, available: DataFrame) -> DataFrame:
    """Hallmark sites -> hallmark features, site by site over the three suffixes, only features that exist."""
    suffixes = F.array(*[F.lit(s) for s in SUFFIXES.values()])
    spread = hallmark_map.select(
        "hallmark", "pos", F.posexplode(F.transform(suffixes, lambda s: F.concat(F.col("site"), s))).alias("m", "feature")
    )
    spread = spread.select("hallmark", (F.col("pos") * len(SUFFIXES) + F.col("m")).alias("pos"), "feature")
    return spread.join(available.select("feature"), "feature").select("hallmark", "pos", "feature")


def hallmark_features(hallmark_feature_map: DataFrame, feature_index: DataFrame) -> DataFrame:
    """Features of each hallmark that the matrix carries, with their column index, in dictionary order.

    A hallmark without any feature simply has no rows.
    """
    return hallmark_feature_map.join(feature_index, "feature").select("hallmark", "pos", "feature", "idx")


def one_hot(df: DataFrame, values: list[str], col: str = "Tissue", prefix: str = TISSUE_PREFIX) -> DataFrame:
    return df.withColumns({f"{prefix}{v}": F.coalesce(F.col(col) == v, F.lit(False)).cast("int") for v in values})


def align_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Wide alignment to a model's feature list: tissue indicators are rebuilt, other absentees are 0."""
    def column(name: str) -> Column:
        if name in df.columns:
            return F.col(name)
        if name.startswith(TISSUE_PREFIX) and "Tissue" in df.columns:
            return F.coalesce(F.col("Tissue") == name[len(TISSUE_PREFIX):], F.lit(False)).cast("int")
        return F.lit(0.0)
    return df.withColumns({name: column(name) for name in wanted if name not in df.columns})


def pack_columns(df: DataFrame, wanted: list[str], out: str = "values") -> DataFrame:
    """The model's features as one array per row, missing values as 0."""
    aligned = align_columns(df, wanted)
    cells = [fill_missing(F.col(c).cast("double")) for c in wanted]
    kept = [c for c in df.columns]
    return aligned.select(*kept, F.array(*cells).alias(out))


def pack_cells(cells: DataFrame, n_features: int) -> DataFrame:
    """Long cells (with column index ``idx``) -> one array per sample; absent cells stay NULL.

    The group of a sample is bounded by the number of features.  Cells are scattered into their places, which takes time
    in proportion to cells and features; two cells for one place are refused, as are places outside of the model.
    """
    schema = T.StructType([cells.schema["sample_id"], T.StructField("values", T.ArrayType(T.FloatType()))])
    step = max(1, BATCH_NUMBERS // max(1, n_features))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                lists = batch.column("cells")
                flat = lists.flatten()
                idx = flat.field("idx").to_numpy(zero_copy_only=False).astype(np.int64)
                if len(idx) and (idx.min() < 0 or idx.max() >= n_features):
                    raise ValueError(f"cells outside of the {n_features} features")
                place = np.repeat(np.arange(batch.num_rows) * n_features, lists.value_lengths().to_numpy(zero_copy_only=False)) + idx
                seen = np.zeros(batch.num_rows * n_features, dtype=bool)
                seen[place] = True
                if seen.sum() != len(place):
                    raise ValueError("a sample has two cells for one feature")
                value = flat.field("value")
                out = np.zeros(len(seen), dtype=np.float32)
                out[place] = np.asarray(value.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.float32)
                seen[place[value.is_null().to_numpy(zero_copy_only=False)]] = False
                ends = np.arange(0, len(seen) + 1, max(n_features, 1), dtype=np.int32)[:batch.num_rows + 1]
                packed = pa.ListArray.from_arrays(pa.array(ends), pa.array(out, mask=~seen))
                yield pa.RecordBatch.from_arrays([batch.column("sample_id"), packed], ["sample_id", "values"])

    grouped = cells.groupBy("sample_id").agg(F.collect_list(F.struct("idx", F.col("value").cast("float").alias("value"))).alias("cells"))
    return grouped.mapInArrow(scatter, schema)


def feature_index(spark, features: list[str]) -> DataFrame:
    """``idx, feature`` as a table: joins find a name by its number however many features there are."""
    names = pa.table({"idx": pa.array(range(len(features)), type=pa.int32()), "feature": pa.array(features, type=pa.string())})
    return spark.createDataFrame(names)


def pick_features(packed: DataFrame, positions: list[int] | tuple[int, ...], col: str = "values") -> DataFrame:
    """Packed rows cut to the features at ``positions``, in their order."""
    at = np.asarray(positions, dtype=np.int64)
    kind = packed.schema[col].dataType
    inner = {"float": pa.float32(), "double": pa.float64()}[kind.elementType.typeName()]
    where = packed.columns.index(col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(where)
            sizes = np.diff(lists.offsets.to_numpy())
            if lists.null_count or (sizes <= at.max(initial=-1)).any():
                raise ValueError("rows with fewer values than the positions need")
            start = np.concatenate([[0], np.cumsum(sizes)])[:-1] if len(sizes) else np.zeros(0, dtype=np.int64)
            values = lists.flatten().take(pa.array((start[:, None] + at).ravel()))
            ends = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * len(at))
            columns = [*batch.columns]
            columns[where] = pa.ListArray.from_arrays(ends, values.cast(inner))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return packed.mapInArrow(cut, packed.schema)


def unpack(packed: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """Packed rows -> long cells with feature names."""
    kept = keep if keep is not None else ["sample_id"]
    cells = packed.select(*kept, F.posexplode("values").alias("idx", "value"))
    return cells.join(feature_index(packed.sparkSession, features), "idx").select(*kept, "idx", "value", "feature")


def spread_experts(long_predictions: DataFrame, hallmarks: list[str], value: str = "pred") -> DataFrame:
    """One column ``pred_resid_<hallmark>`` per hallmark."""
    wide = long_predictions.groupBy("sample_id").pivot("hallmark", hallmarks).agg(F.first(value))
    return wide.withColumnsRenamed({h: f"{EXPERT_PREFIX}{h}" for h in hallmarks})


def join_stages(stage1: DataFrame, stage2: DataFrame, experts: list[str]) -> DataFrame:
    wanted = ["sample_id"] + [c for c in experts if c not in stage1.columns]
    return stage1.join(stage2.select(*wanted), "sample_id", "inner")


def pc_names(columns: list[str]) -> list[str]:
    return [c for c in columns if c.startswith(PC_PREFIX)]


def join_context(df: DataFrame, context: DataFrame, training: bool) -> DataFrame:
    """Add the context components: only samples that have them in training, zeros for the others in scoring."""
    pcs = pc_names(context.columns)
    joined = df.join(drop_overlap(df, context.select("sample_id", *pcs)), "sample_id", "inner" if training else "left")
    return joined if training else joined.fillna(0.0, pcs)


def order_output(df: DataFrame, first: list[str], rest: bool) -> DataFrame:
    """Result columns first, then expert columns, then (in training tables) all others."""
    lead = [c for c in first if c in df.columns]
    experts = [c for c in df.columns if c.startswith((EXPERT_PREFIX, "pred_age_")) and c not in lead]
    others = [c for c in df.columns if c not in lead + experts] if rest else []
    return df.select(*lead, *experts, *others)


def hallmark_of_prefixed(name: Column) -> Column:
    return strip_prefix(name, EXPERT_PREFIX)


FIRST_TRAINING = ["sample_id", "age", "fused_age", STAGE1_PRED, "stage3_correction", "Tissue", "project_id"]
FIRST_SCORING = ["sample_id", "Age", "Tissue", "fused_age", STAGE1_PRED, "pred_residual_stage3", "project_id"]
