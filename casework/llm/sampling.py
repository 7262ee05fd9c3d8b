"""Bounded samples of labelled rows to fit a model on."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of the hash that decides who is in a sample.
STEPS = 1 << 30


def remainder(key: str, of: int) -> Column:
    """crc32 of the key as text, modulo ``of``; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % of


def bounded(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows by a hash of ``key`` where there are more, else all; the same ones each time."""
    count = rows.count()
    if count <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(STEPS)) < int(STEPS * most / count))


def bounded_each(rows: DataFrame, key: str, group: str, counts: dict, most: int) -> DataFrame:
    """About ``most`` rows of each group with more, by a hash of ``key``, and all of the others."""
    over = {name: int(STEPS * most / n) for name, n in counts.items() if n > most}
    if not over:
        return rows
    spark = rows.sparkSession
    limits = spark.createDataFrame([*over.items()], f"`{group}` string, _steps long")
    limited = rows.join(F.broadcast(limits), group, "left")  # one row for each group
    chosen = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(STEPS)) < F.coalesce("_steps", F.lit(STEPS))
    return limited.where(chosen).select(*rows.columns)
