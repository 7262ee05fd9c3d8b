"""Exact ranks and order statistics without a single-task sort.

Rows are range-partitioned by (group, order), so even one huge group is spread over many tasks. Each
task ranks its own range; the ranges' sizes, one row per range and group, give the offsets. The ranged
rows are checkpointed once, because the range bounds are sampled and both uses must see the same ranges.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from casework.operators.dimension import join_groups
from casework.session import checkpoint

SALTS = 32


def _offsets(sizes: DataFrame, by: list[str]) -> DataFrame:
    """Rows before each range, and rows in all, per group. ``sizes`` has one row per (group, range)."""
    whole = Window.partitionBy(*by)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn(
        "_before", F.coalesce(F.sum("_size").over(before), F.lit(0))
    ).withColumn("_total", F.sum("_size").over(whole))


def ranked_rows(df: DataFrame, order: list[str], by: list[str] = ()) -> DataFrame:
    """``df`` with ``rank`` (from 1) and ``group_size`` (bigint) inside each ``by`` group.

    ``order`` must be unique inside a group. Select only the needed columns first: all of them are
    written to the checkpoint.
    """
    by = list(by)
    ranged = (
        df.repartitionByRange(*by, *order)
        .sortWithinPartitions(*by, *order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    cut = checkpoint(ranged).select(
        *df.columns,
        F.shiftright("_id", 33).alias("_part"),
        F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"),
    )
    sizes = cut.groupBy(*by, "_part").agg(
        F.count(F.lit(1)).alias("_size"), F.min("_row").alias("_first")
    )
    return join_groups(cut, _offsets(sizes, by), [*by, "_part"]).select(
        *df.columns,
        (F.col("_before") + F.col("_row") - F.col("_first") + 1).alias("rank"),
        F.col("_total").alias("group_size"),
    )


def ranked_values(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Distinct non-NULL values per group with their count ``n``, the number of rows ``below`` them and
    the group's ``total``. Equal values are counted before the shuffle, so a hot value is one row."""
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return ranked_counts(counts, value, by)


def ranked_counts(counts: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``ranked_values`` of values that are counted already: one row with ``n`` for each group and value."""
    ranged = counts.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id())
    cut = checkpoint(ranged)
    sizes = cut.groupBy(*by, "_part").agg(F.sum("n").alias("_size"))
    inside = (
        Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = cut.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return join_groups(local, _offsets(sizes, by), [*by, "_part"]).select(
        *by,
        value,
        "n",
        (F.col("_before") + F.col("_inside")).alias("below"),
        F.col("_total").alias("total"),
    )


def quantile(value: str, q: float) -> Column:
    """Aggregate over ``ranked_values`` rows: the ``q`` quantile, interpolated linearly."""
    at = (F.col("total") - 1) * F.lit(float(q))
    low, high = F.floor(at), F.ceil(at)

    def holding(position: Column) -> Column:
        inside = (F.col("below") <= position) & (position < F.col("below") + F.col("n"))
        return F.max(F.when(inside, F.col(value).cast("double")))

    share = F.max(at - low)
    return holding(low) + (holding(high) - holding(low)) * share


def first_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` rows by ``order``; each task keeps ``n`` rows before they meet."""
    return df.orderBy(*order).limit(n)


def _pruned(df: DataFrame, n: int, order: list[str], by: list[str]) -> DataFrame:
    salted = Window.partitionBy(*by, "_salt").orderBy(*order)
    return (
        df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
        .withColumn("_rank", F.row_number().over(salted))
        .where(F.col("_rank") <= n)
        .select(*df.columns)
    )


def first_rows_per_group(df: DataFrame, n: int, order: list[str], by: list[str]) -> DataFrame:
    """The first ``n`` rows of each group, with their ``rank``; a hot group is pruned per salt first."""
    inside = Window.partitionBy(*by).orderBy(*order)
    return (
        _pruned(df, n, order, by)
        .withColumn("rank", F.row_number().over(inside))
        .where(F.col("rank") <= n)
        .withColumn("rank", F.col("rank").cast("long"))
    )
