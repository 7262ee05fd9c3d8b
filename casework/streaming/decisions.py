"""The decision layer on arriving results. No operator of its own: the batch projections are used as they
are, and need no state."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from casework.operators.decision import SEVERE_DEFAULT, Severe
from casework.plans.scoring_run import scored_run


def read_results_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result files (Parquet) as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def write_decisions(
    results: DataFrame, path: str, progress: str, severe: Severe = SEVERE_DEFAULT, **trigger
) -> StreamingQuery:
    """Decide and normalise each arriving row and append it to Parquet files.

    ``progress`` is a shared folder for the stream's own checkpoint; with it a restart goes on where the
    last run ended and writes nothing twice.
    """
    writer = scored_run(results, severe=severe).writeStream.format("parquet").outputMode("append")
    return writer.option("checkpointLocation", progress).trigger(**trigger).start(path)
