"""Files read by ranges of bytes, whatever their size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import settle

RANGE_BYTES = 64 << 20
#: Nodes below one node of the hash tree.
FAN = 1024
_READ = 1 << 20


def open_file(uri: str) -> pa.NativeFile:
    """A file that pyarrow's file systems reach, for reading from any place."""
    from pyarrow import fs

    if uri.startswith("file:"):
        system, path = fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    else:
        system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def file_trees(spark: SparkSession, path: str, pattern: str = "*", range_bytes: int = RANGE_BYTES, fan: int = FAN) -> DataFrame:
    """``path, file, length, n_ranges, digest`` of every file below a folder, files of any size.

    Tasks take the sha256 of ranges of ``range_bytes``.  Then ``fan`` neighbouring digests (hex, end to end) at a time become
    one, until a file has one left: the digest of a file of a single range is the plain sha256 of its bytes.  Empty files have
    no row, as Spark's file scan passes over them.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
             .load(path).select("path", "length"))
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))
    ranges = settle(files.select("path", "length", F.posexplode(starts).alias("pos", "start")), "ranges")
    n, most = ranges.agg(F.count(F.lit(1)), F.max("pos")).first()
    tasks = max(1, min(n, max(spark.sparkContext.defaultParallelism, -(-n // 16))))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for uri, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                state, left = hashlib.sha256(), range_bytes
                with open_file(uri) as file:
                    file.seek(start)
                    while left > 0 and (block := file.read(min(_READ, left))):
                        state.update(block)
                        left -= len(block)
                made.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.string())], ["path", "length", "pos", "digest"])

    hashed = ranges.repartition(tasks).mapInArrow(digests, "path string, length bigint, pos int, digest string")
    nodes = settle(hashed, "digests").withColumn("n_ranges", F.ceil(F.col("length") / range_bytes))
    nodes, left = nodes.withColumn("n", F.col("n_ranges")), (most or 0) + 1
    while left > 1:
        listed = F.array_sort(F.collect_list(F.struct("pos", "digest")))
        joined = nodes.groupBy("path", "length", "n_ranges", "n", F.floor(F.col("pos") / fan).alias("up")).agg(listed.alias("below"))
        text = F.array_join(F.col("below.digest"), "")
        nodes = joined.select("path", "length", "n_ranges", F.col("up").alias("pos"), F.when(F.col("n") == 1, text).otherwise(F.sha2(text, 256)).alias("digest"),
                              F.ceil(F.col("n") / fan).alias("n"))
        left = -(-left // fan)
    return nodes.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), "length", "n_ranges", "digest")
