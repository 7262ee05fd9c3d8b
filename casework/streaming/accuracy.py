"""Accuracy and outcomes that go on while responses arrive.

The state of the stream is one row of sums for each block of cases, or for each group of outcomes. Every micro-batch
writes the rows that it changed into a folder of its own number; a batch that runs again after a failure writes the
same folder again. The latest row of a block is its total, so files may arrive in any order.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from casework.operators.evaluation import passk_aggregates
from casework.operators.responses import accumulated, block_totals


def _write_changes(totals: DataFrame, path: str, progress: str, trigger: dict) -> StreamingQuery:
    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    stream = totals.writeStream.outputMode("update").foreachBatch(write)
    return stream.option("checkpointLocation", progress).trigger(**trigger).start()


def _latest(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    changes = spark.read.parquet(path)
    rest = [c for c in changes.columns if c not in (*by, "batch")]
    last = F.max_by(F.struct(*rest), "batch").alias("_last")
    grouped = changes.groupBy(*by) if by else changes.groupBy()
    return grouped.agg(last).where(F.col("_last").isNotNull()).select(*by, "_last.*")


def write_running_accuracy(
    results: DataFrame, path: str, progress: str, order: str = "case_num", right: str = "is_correct", every: int = 50, **trigger
) -> StreamingQuery:
    """Add arriving results to the totals of their blocks. ``progress`` is the stream's own checkpoint folder; with it a
    restart goes on where the last run ended. Case numbers must not arrive twice."""
    return _write_changes(block_totals(results, order, right, every), path, progress, trigger)


def read_running_accuracy(spark: SparkSession, path: str) -> DataFrame:
    """R8 over what has arrived: (cases, correct, accuracy) after each block, as ``running_accuracy`` gives it."""
    return accumulated(_latest(spark, path, ["block"]))


def write_outcomes(flags: DataFrame, path: str, progress: str, by: list[str] = (), **trigger) -> StreamingQuery:
    """Add arriving outcome flags (E3) to the counts of all, or of each group."""
    grouped = flags.groupBy(*by) if by else flags.groupBy()
    return _write_changes(grouped.agg(*passk_aggregates()), path, progress, trigger)


def read_outcomes(spark: SparkSession, path: str, by: list[str] = ()) -> DataFrame:
    """E4 over what has arrived, as ``passk_summary`` gives it."""
    return _latest(spark, path, list(by))
