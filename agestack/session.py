"""Session set-up for local runs, and the one way this package cuts lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema

_runs: dict[str, str] = {}


def local_session(app: str = "agestack", cores: str | int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a session whose tasks run in the driver's own process may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if "" not in _runs:
        _runs[""] = tempfile.mkdtemp(prefix="agestack-")
        atexit.register(shutil.rmtree, _runs[""], ignore_errors=True)
    return _runs[""]


def run_folder(spark: SparkSession) -> str:
    """This application's own folder below the shared one; it is deleted when the driver's JVM ends."""
    app = spark.sparkContext.applicationId
    if app not in _runs:
        folder = f"{shared_dir(spark)}/agestack/run-{uuid.uuid4().hex}"
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        _runs[app] = folder
    return _runs[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables now.  Tables that are still to be read must be stored first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Few rows of the driver as a table.  They go by Arrow, so no Python worker is started and Spark knows that they are few."""
    fields = to_arrow_schema(T.StructType.fromDDL(schema))
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(fields.names, r)) for r in rows], schema=fields))


def settle(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The written table survives lost executors and cuts the lineage.  Spark then knows its real size, so
    a later join broadcasts it only below ``spark.sql.autoBroadcastJoinThreshold`` and sorts and merges
    it otherwise: no join in this package carries a broadcast hint.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
