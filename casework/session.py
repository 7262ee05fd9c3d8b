"""Session settings, the shared folder and tables written to it."""

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "casework", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``; where none is named, a folder of the
    warehouse. Off local mode that must not be a folder of the driver's machine: then this is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if not spark.sparkContext.master.startswith("local") and re.match(r"(file:|(?![A-Za-z][A-Za-z0-9+.-]*:))", warehouse):
        raise ValueError("name a folder that the driver and all executors share in spark.checkpoint.dir")
    return warehouse.rstrip("/") + "/_casework"


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written rows."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def _hadoop(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, whatever store it is in."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/casework-{name}-{uuid.uuid4().hex}"
    place, system = _hadoop(spark, path)
    system.mkdirs(place.getParent())
    system.mkdirs(place)  # only what is there can be marked
    system.deleteOnExit(place)
    system.delete(place, True)
    return path


def written(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared folder and read again, and its path."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of ``written`` that no later step reads."""
    place, system = _hadoop(spark, path)
    system.delete(place, True)


def let_workers_import(spark: SparkSession) -> None:
    """Let Python workers find this package where it lies on the driver's path only.

    On a cluster it is installed, or sent with ``--py-files``; then this changes nothing.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
