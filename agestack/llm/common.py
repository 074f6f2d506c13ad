"""What several operators of this subpackage share."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from agestack import session

#: Rows sent to Python at a time while a step is written; they hold whole texts, and both sides keep a batch in memory.
BATCH_ROWS = 1000

#: A word: a run of anything but the six white space characters of ASCII.
WORD = r"[^\x20\x09-\x0D]+"

#: At most so many short rows (a few numbers each) are sent to every task at once.
BROADCAST_ROWS = 500_000


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Within it, tasks exchange batches of at most ``rows`` rows with Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def settle(df: DataFrame, label: str = "table", rows: int = BATCH_ROWS) -> DataFrame:
    """Written to the shared folder and read back, in batches of at most ``rows`` rows where Python takes part.

    The shuffle files behind ``df`` are then of no more use.  Spark deletes them once the driver has collected the objects
    that name them, which may be long after, so the driver is asked to collect now.
    """
    spark = df.sparkSession
    with small_batches(spark, rows):
        written = session.settle(df, label)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return written


def release(spark: SparkSession) -> None:
    """Have the driver let go of the shuffle files behind written steps, and wait a moment for it.

    Events of the last step that still wait to be logged hold on to its plan, hence the second time.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7)


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that no later step reads."""
    for table in tables:
        spark = table.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(column: str = "text") -> Column:
    """The text, empty where there is none."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of ``WORD``.  Splitting at one plain character needs no regular expression, and is linear, while
    extracting all matches copies the text for each of them."""
    for gap in "\t\n\v\f\r":
        text = F.replace(text, F.lit(gap), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def frame(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "documents")


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows; otherwise joins shuffle both sides.

    Give it written tables of a few numbers per row, so that counting costs little and the limit bounds bytes.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
