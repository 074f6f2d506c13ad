"""From modality tables and context to packed input on the anchor ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators.align import align_to_anchor, feature_index, melt_modality, pack_cells, pc_names, stack_modalities
from ..operators.contract import require_unique
from ..operators.ranking import number_rows
from ..session import settle
from ..sources import wide


@dataclass
class Assembled:
    """``packed`` (``sample_id, values``), ``features`` (``idx, feature``) and ``excluded`` (``sample_id, reason``)."""

    packed: DataFrame
    features: DataFrame
    excluded: DataFrame

    def names(self) -> list[str]:
        return [r["feature"] for r in self.features.orderBy("idx").collect()]


def assemble(anchor: DataFrame, modalities: dict[str, DataFrame], context: DataFrame | None = None,
             features: DataFrame | None = None, samples: DataFrame | None = None) -> Assembled:
    """Pack wide modality tables, and the components of ``context``, for the ids of ``anchor``.

    An id that some tables lack keeps its row, with NULL where they would stand.  Excluded are ids that no table has
    (reason ``no features``) and, where ``samples`` are given, ids without an age (``no age``).  ``features`` (``idx,
    feature``) is the order of a stored model, whose other features stay NULL; by default all features in name order.
    """
    for table in (anchor, *modalities.values(), *([] if context is None else [context])):
        require_unique(table)
    ids = anchor.select("sample_id")
    parts = [melt_modality(wide.join(ids, "sample_id", "left_semi"), name) for name, wide in modalities.items()]
    if context is not None:
        pcs = context.select("sample_id", *pc_names(context.columns)).join(ids, "sample_id", "left_semi")
        parts.append(melt_modality(pcs, "context"))
    cells = settle(stack_modalities(parts), "cells")
    if features is None:
        numbered = number_rows(cells.select("feature").distinct(), ["feature"], "n")
        features = numbered.select((F.col("n") - 1).cast("int").alias("idx"), "feature")
    features = settle(features.select("idx", "feature"), "features")
    width = features.agg(F.max("idx")).first()[0]
    present = cells.select("sample_id").distinct()
    reason = F.lit("no features")
    known = ids.join(present.withColumn("__has", F.lit(True)), "sample_id", "left")
    if samples is not None:
        ages = samples.select("sample_id", F.col("Age").isNotNull().alias("__age"))
        known = known.join(ages, "sample_id", "left")
        reason = F.when(F.col("__has").isNull(), "no features").otherwise("no age")
    fit = F.col("__has").isNotNull() & (F.coalesce("__age", F.lit(False)) if samples is not None else F.lit(True))
    excluded = settle(known.filter(~fit).select("sample_id", reason.alias("reason")), "excluded")
    kept = ids.join(excluded, "sample_id", "left_anti")
    wanted = cells.join(features, "feature").join(kept, "sample_id", "left_semi").select("sample_id", "idx", "value")
    packed = pack_cells(wanted, (width if width is not None else -1) + 1)
    empty = F.array_repeat(F.lit(None).cast("float"), (width if width is not None else -1) + 1)
    whole = align_to_anchor(kept, packed, checked=False).withColumn("values", F.coalesce("values", empty))
    return Assembled(whole, features, excluded)


def assemble_files(anchor: DataFrame, paths: dict[str, str], context: DataFrame | None = None,
                   features: DataFrame | None = None, samples: DataFrame | None = None) -> Assembled:
    """``assemble`` for modality files (Parquet) of any width, with the same result.

    Files are read by tiles of columns, and one shuffle by sample joins the pieces of all files, the components and the
    anchor, so neither plans nor rows grow with the number of features.  ``packed`` is written once.
    """
    spark = anchor.sparkSession
    for table in (anchor, *([] if context is None else [context])):
        require_unique(table)
    ids = anchor.select(F.col("sample_id").cast("string").alias("sample_id"))
    layouts = {name: settle(wide.file_layouts(spark, path), "layouts") for name, path in paths.items()}
    found = {name: wide.feature_names(files, name) for name, files in layouts.items()}
    if context is not None:
        found["context"] = {pc: pc for pc in pc_names(context.columns)}
    all_names = sorted(name for names in found.values() for name in names)
    if len(set(all_names)) < len(all_names):
        raise ValueError("two tables have the same feature")
    if features is None:
        features = feature_index(spark, all_names)
    features = settle(features.select("idx", "feature"), "features")
    order = features.orderBy("idx").toArrow()
    numbers, names = order.column("idx").to_pylist(), order.column("feature").to_pylist()
    width = numbers[-1] + 1 if numbers else 0
    pieces, places = [], []
    for name, columns in found.items():
        here = [(idx, columns[feature]) for idx, feature in zip(numbers, names) if feature in columns]
        wanted, part = [column for _, column in here], len(places)
        places.append([idx for idx, _ in here])
        pieces.append(wide.frame_pieces(context, wanted, part) if name == "context" else wide.file_pieces(layouts[name], wanted, part))
    joined = stack_modalities(pieces) if pieces else spark.createDataFrame([], wide.PIECES)
    rows = settle(wide.gather(joined, places, width, ids), "packed")
    known = rows.select("sample_id", "n_parts")
    reason = F.when(F.col("n_parts") == 0, "no features")
    if samples is not None:
        ages = samples.select("sample_id", F.col("Age").isNotNull().alias("__age"))
        known = known.join(ages, "sample_id", "left")
        reason = reason.when(~F.coalesce("__age", F.lit(False)), "no age")
    excluded = settle(known.select("sample_id", reason.alias("reason")).filter("reason IS NOT NULL"), "excluded")
    packed = rows.select("sample_id", "values").join(excluded, "sample_id", "left_anti")
    return Assembled(packed, features, excluded)
