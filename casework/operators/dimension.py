"""Joins to small tables: broadcast below a checked size, shuffle join above it."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

MAX_ROWS = 200_000
MAX_BYTES = 64 * 1024 * 1024
SALTS = 16


def fits_in_memory(dim: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> bool:
    """Measure ``dim``; reading stops after ``max_rows`` + 1 rows."""
    rows, size = (
        dim.limit(max_rows + 1)
        .agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*")))))
        .first()
    )
    return rows <= max_rows and (size or 0) <= max_bytes


def join_dimension(
    df: DataFrame, dim: DataFrame, key: str, spread_by: str, max_rows: int = MAX_ROWS
) -> DataFrame:
    """Left join of ``df`` to ``dim`` on ``key``, which is unique in ``dim``.

    Above the size limit, rows with one hot key are spread over ``SALTS`` tasks by ``spread_by``. Spark sizes the
    copies by the files that they come from, so it is told not to broadcast them after all.
    """
    if fits_in_memory(dim, max_rows):
        return df.join(F.broadcast(dim), key, "left")
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)))
    salts = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    copies = dim.withColumn("_salt", F.explode(salts))
    return salted.join(copies.hint("merge"), [key, "_salt"], "left").drop("_salt")


def join_rows(df: DataFrame, other: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join of two tables with a row per ``key``, both as large as the data.

    Spark sizes them by the files that they come from, which says little of parsed cells, and would broadcast
    millions of rows; so it is told to merge. Sides that are stored by ``key`` do not move.
    """
    return df.join(other.hint("merge"), key, how)


def join_groups(
    df: DataFrame, groups: DataFrame, by: list[str], max_rows: int = MAX_ROWS
) -> DataFrame:
    """Inner join of rows to what is known of their group, NULL keys included.

    ``groups`` should come from a checkpoint, as it is measured first. Above the size limit it is left to a
    shuffle join, whose hot keys adaptive execution splits.
    """
    right = groups.withColumnsRenamed({name: f"_of_{name}" for name in by})
    if fits_in_memory(right, max_rows):
        right = F.broadcast(right)
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_of_{n}")) for n in by])
    return df.join(right, same).drop(*[f"_of_{name}" for name in by])
