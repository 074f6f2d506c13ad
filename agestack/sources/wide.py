"""Very wide Parquet files as packed rows: no plan holds a column per feature and no row is made per cell.

A tile is a row group cut to some of the wanted columns.  Tasks read tiles column by column, turn them, and emit one
piece of bytes per sample and tile; one shuffle by sample brings the pieces of all files together, and each row is put
together from its pieces in sorted order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.align import BATCH_NUMBERS, feature_index
from ..schema import METADATA, NOT_FEATURES, SUFFIXES
from ..session import settle
from .files import open_file

#: Numbers of one tile.
TILE_NUMBERS = 4 << 20
#: Tiles of one task, where there are enough of them to keep all cores busy.
TASK_TILES = 16

PIECES = T.StructType([
    T.StructField("sample_id", T.StringType()), T.StructField("part", T.IntegerType()),
    T.StructField("start", T.IntegerType()), T.StructField("piece", T.BinaryType()),
])
GATHERED = T.StructType([
    T.StructField("sample_id", T.StringType()), T.StructField("n_parts", T.IntegerType()),
    T.StructField("values", T.ArrayType(T.FloatType())),
])
_MISSING = np.float32(np.nan)


def _open(uri: str) -> pq.ParquetFile:
    return pq.ParquetFile(open_file(uri))


def _id_column(names: list[str]) -> str:
    if "sample_id" in names:
        return "sample_id"
    return next((c for c in names if c.lower() == "sample_id"), names[0])


def _numeric_columns(schema: pa.Schema) -> list[str]:
    """Columns that are features: numbers, neither the id nor metadata (in the contract's or in lower case)."""
    names = schema.names
    lower = {m.lower() for m in METADATA if m not in names}
    skipped = {_id_column(names), *NOT_FEATURES, *lower}
    number = [pa.types.is_integer, pa.types.is_floating, pa.types.is_decimal]
    return [f.name for f in schema if f.name not in skipped and any(kind(f.type) for kind in number)]


def file_layouts(spark: SparkSession, path: str) -> DataFrame:
    """``path, layout, row_groups`` of every file below ``path``; only footers are read.

    ``layout`` is a digest of names and types, equal for files of the same columns; ``row_groups`` are their rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uris, digests, groups = batch.column(0).to_pylist(), [], []
            for uri in uris:
                with _open(uri) as file:
                    digests.append(hashlib.sha256(file.schema_arrow.to_string(show_schema_metadata=False).encode()).hexdigest())
                    groups.append([file.metadata.row_group(g).num_rows for g in range(file.num_row_groups)])
            yield pa.RecordBatch.from_arrays([pa.array(uris, pa.string()), pa.array(digests, pa.string()), pa.array(groups, pa.list_(pa.int64()))],
                                             ["path", "layout", "row_groups"])

    return files.mapInArrow(footers, "path string, layout string, row_groups array<bigint>")


def feature_names(layouts: DataFrame, modality: str) -> dict[str, str]:
    """Feature -> column of all files, the feature with the modality's suffix.  One file per layout is opened.

    The dictionary is held by the driver, like every list of feature names.  Two columns for one feature are refused.
    """
    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with _open(uri) as file:
                    yield pa.RecordBatch.from_arrays([pa.array(_numeric_columns(file.schema_arrow), pa.string())], ["column"])

    one_each = layouts.groupBy("layout").agg(F.min("path").alias("path")).select("path")
    found = one_each.mapInArrow(names, "column string").distinct().toArrow().column("column").to_pylist()
    suffix = SUFFIXES.get(modality, "")
    out: dict[str, str] = {}
    for column in sorted(found):
        feature = column if column.endswith(suffix) else column + suffix
        if feature in out:
            raise ValueError(f"columns {out[feature]!r} and {column!r} are one feature")
        out[feature] = column
    return out


def file_pieces(layouts: DataFrame, columns: list[str], part: int, tile_numbers: int = TILE_NUMBERS) -> DataFrame:
    """``sample_id, part, start, piece``: 32-bit floats of ``columns[start:]``, as many as the piece holds.

    Missing values and columns a file lacks are NaN.  Rows without an id are left out.  A tile holds at most
    ``tile_numbers`` numbers, or one column where a row group has more rows.
    """
    spark = layouts.sparkSession
    step = F.greatest(F.lit(1), F.floor(F.lit(tile_numbers) / F.col("rows"))).cast("int")
    groups = layouts.select("path", F.posexplode("row_groups").alias("group", "rows")).filter("rows > 0")
    starts = F.explode(F.sequence(F.lit(0), F.lit(max(len(columns), 1) - 1), F.col("step")))
    tiles = settle(groups.withColumn("step", step).select("path", "group", starts.alias("start"), "step"), "tiles")
    n_tiles = tiles.count()
    tasks = max(1, min(n_tiles, max(spark.sparkContext.defaultParallelism, -(-n_tiles // TASK_TILES))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, file, known, id_column = None, None, set(), ""
        for batch in batches:
            for tile in batch.to_pylist():
                if tile["path"] != opened:
                    if file is not None:
                        file.close()
                    opened, file = tile["path"], _open(tile["path"])
                    known, id_column = set(_numeric_columns(file.schema_arrow)), _id_column(file.schema_arrow.names)
                wanted = columns[tile["start"]:tile["start"] + tile["step"]]
                table = file.read_row_group(tile["group"], columns=[id_column, *(c for c in wanted if c in known)], use_threads=False)
                ids = table.column(id_column)
                kind = ids.type.value_type if pa.types.is_dictionary(ids.type) else ids.type
                if not (pa.types.is_integer(kind) or pa.types.is_string(kind) or pa.types.is_large_string(kind)):
                    raise ValueError(f"ids in {id_column!r} are neither text nor whole numbers")
                turned = np.full((len(wanted), table.num_rows), _MISSING, dtype=np.float32)
                for at, column in enumerate(wanted):
                    if column in known:
                        turned[at] = table.column(column).cast(pa.float32(), safe=False).to_numpy()
                ids = ids.cast(pa.string()).combine_chunks()
                yield _piece_batch(ids, part, tile["start"], np.ascontiguousarray(turned.T))

    dealt = tiles.repartition(tasks).sortWithinPartitions("path", "group", "start")
    return dealt.mapInArrow(read, PIECES).filter("sample_id IS NOT NULL")


def frame_pieces(df: DataFrame, columns: list[str], part: int) -> DataFrame:
    """The same pieces of a table of few columns, one per row."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.empty((batch.num_rows, len(columns)), dtype=np.float32)
            for at in range(len(columns)):
                rows[:, at] = batch.column(at + 1).to_numpy(zero_copy_only=False)
            yield _piece_batch(batch.column(0), part, 0, rows)

    floats = [F.col(c).cast("float").alias(c) for c in columns]
    return df.select(F.col("sample_id").cast("string").alias("sample_id"), *floats).mapInArrow(read, PIECES).filter("sample_id IS NOT NULL")


def _piece_batch(ids: pa.Array, part: int, start: int, rows: np.ndarray) -> pa.RecordBatch:
    n, width = rows.shape
    ends = pa.py_buffer(np.arange(n + 1, dtype=np.int64) * (4 * width))
    pieces = pa.Array.from_buffers(pa.large_binary(), n, [None, ends, pa.py_buffer(rows)]).cast(pa.binary())
    place = [pa.array(np.full(n, v, dtype=np.int32)) for v in (part, start)]
    return pa.RecordBatch.from_arrays([ids.cast(pa.string()), *place, pieces], PIECES.names)


def gather(pieces: DataFrame, places: list[list[int]], width: int, anchor: DataFrame | None = None) -> DataFrame:
    """Pieces -> ``sample_id, n_parts, values``: rows of ``width`` floats, NULL where no piece has a number.

    Number ``i`` of part ``p`` goes to ``places[p][i]``.  With ``anchor`` there is one row per anchor id, also for ids
    without any piece (``n_parts`` 0), and none for other ids.  A sample with two rows in one part is refused.
    """
    to = [np.asarray(p, dtype=np.int64) for p in places]
    marked = anchor is not None
    if marked:
        marks = [F.lit(-1), F.lit(0), F.lit(None).cast("binary")]
        pieces = anchor.select("sample_id", *[m.alias(n) for m, n in zip(marks, PIECES.names[1:])]).unionByName(pieces)
    per_batch = max(1, BATCH_NUMBERS // max(width, 1))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray]]:
        current, held, row, parts, last = None, False, None, 0, (-2, 0)
        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for sample, part, start, piece in zip(*[c.to_pylist() for c in columns[:3]], columns[3]):
                if sample != current:
                    if held:
                        yield current, parts, row
                    current, held, parts, last = sample, not marked or part == -1, 0, (-2, 0)
                    row = np.full(width, _MISSING, dtype=np.float32) if held else None
                if (part, start) == last:
                    raise ValueError(f"sample {sample!r} has two rows in one table")
                if part >= 0 and held:
                    numbers = np.frombuffer(piece.as_buffer(), dtype=np.float32)
                    row[to[part][start:start + len(numbers)]] = numbers
                    parts += part != last[0]
                last = (part, start)
        if held:
            yield current, parts, row

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, int, np.ndarray]] = []
        for made in rows(batches):
            out.append(made)
            if len(out) == per_batch:
                yield as_batch(out)
                out = []
        if out:
            yield as_batch(out)

    def as_batch(made: list[tuple[str, int, np.ndarray]]) -> pa.RecordBatch:
        flat = np.concatenate([m[2] for m in made])
        ends = pa.array(np.arange(len(made) + 1, dtype=np.int32) * width)
        values = pa.ListArray.from_arrays(ends, pa.array(flat, mask=np.isnan(flat)))
        return pa.RecordBatch.from_arrays(
            [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int32()), values], GATHERED.names)

    return pieces.repartition("sample_id").sortWithinPartitions("sample_id", "part", "start").mapInArrow(assemble, GATHERED)


@dataclass
class PackedFile:
    """``packed`` (``sample_id, values``) and ``features`` (``idx, feature``)."""

    packed: DataFrame
    features: DataFrame


def read_packed(spark: SparkSession, path: str, modality: str, features: list[str] | None = None) -> PackedFile:
    """A wide Parquet file or folder as packed rows, in the order of ``features`` or else of all feature names.

    Only wanted columns are read.  Wanted features that no file has are NULL in every row.
    """
    layouts = settle(file_layouts(spark, path), "layouts")
    found = feature_names(layouts, modality)
    names = sorted(found) if features is None else list(features)
    here = [(idx, found[name]) for idx, name in enumerate(names) if name in found]
    pieces = file_pieces(layouts, [column for _, column in here], 0)
    packed = gather(pieces, [[idx for idx, _ in here]], len(names)).select("sample_id", "values")
    return PackedFile(packed, feature_index(spark, names))
