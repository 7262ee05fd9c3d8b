"""Sampling, limits and positional selection."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from casework.operators.ranking import first_rows, first_rows_per_group, ranked_rows
from casework.operators.selection import rows_at

# Hex digits of the hash by which rows are counted, and numbered apart from each other.
CUT_DIGITS = 4


def sample_key(seed: int, key: str) -> Column:
    """A fixed pseudo-random text per row: the md5 of ``seed|key``."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def _numbered(df: DataFrame, wanted: Column, seed: int, key: str, by: list[str], number: str) -> DataFrame:
    """The ``wanted`` rows of each group with the smallest hashes, numbered from 1.

    Counts per hash prefix tell how many rows come before each prefix, so the rows of a prefix are numbered
    on their own, whatever the size of the sample; rows of later prefixes go no further than the scan.
    """
    hashed = df.withColumn("_hash", sample_key(seed, key)).withColumn(
        "_prefix", F.substring("_hash", 1, CUT_DIGITS)
    )
    counts = hashed.groupBy(*by, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    # At most 16 ** CUT_DIGITS rows per wanted group.
    upto = Window.partitionBy(*by).orderBy("_prefix")
    filled = counts.withColumn("_before", F.sum("_n").over(upto) - F.col("_n"))
    started = filled.where(F.col("_before") < wanted).drop("_n")
    near = hashed.join(F.broadcast(started), [*by, "_prefix"])
    inside = Window.partitionBy(*by, "_prefix").orderBy("_hash", key)
    numbered = near.withColumn(number, F.col("_before") + F.row_number().over(inside))
    return numbered.where(F.col(number) <= wanted).select(*df.columns, number)


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """``min(n, N)`` rows without replacement, the same for the same ``seed`` however the rows are
    partitioned. ``key`` is unique. Adds ``case_num`` 1..n."""
    return _numbered(df, F.lit(n), seed, key, [], "case_num")


def shuffle_take(
    df: DataFrame, takes: dict[str, int], seed: int, key: str, split: str = "split"
) -> DataFrame:
    """A seeded shuffle of each split, then its first rows. Adds ``position`` from 1."""
    wanted = F.lit(None).cast("long")
    for name, n in takes.items():
        wanted = F.when(F.col(split) == name, F.lit(n)).otherwise(wanted)
    named = df.where(F.col(split).isin(list(takes)))
    return _numbered(named, wanted, seed, key, [split], "position")


def take_first(df: DataFrame, n: int, order_key: str) -> DataFrame:
    """The first ``n`` rows by ``order_key``."""
    return first_rows(df, n, [order_key])


def take_positions(df: DataFrame, order_key: str, positions: list[int]) -> DataFrame:
    """The rows at the listed positions (from 0) by ``order_key``; those out of range are skipped.

    Counts narrow down where they are; keys of other types than numbers, times and texts are ranked whole.
    """
    keys = df.select(order_key)
    wanted = rows_at(keys, [order_key], list(positions))
    if wanted is None:
        ranks = ranked_rows(keys, [order_key]).select(order_key, (F.col("rank") - 1).alias("position"))
        wanted = ranks.where(F.col("position").isin(list(positions)))
    return df.join(F.broadcast(wanted), order_key)  # at most len(positions) rows


def sample_fraction_per_group(
    df: DataFrame, group: str, order: str, frac: float
) -> DataFrame:
    """The first ``max(1, floor(size * frac))`` rows of each group by ``order``."""
    take = F.greatest(F.lit(1), F.floor(F.col("group_size") * F.lit(float(frac))))
    return ranked_rows(df, [order], [group]).where(F.col("rank") <= take).drop("rank", "group_size")


def fraction_stats(df: DataFrame, group: str, frac: float) -> DataFrame:
    """Rows selected, rows in all and percentage per group."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("total"))
    selected = F.greatest(F.lit(1), F.floor(F.col("total") * F.lit(float(frac))))
    return sizes.withColumn("selected", selected.cast("long")).withColumn(
        "selected_pct", F.col("selected") / F.col("total") * 100
    )


def top_n_per_group(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each group by ``order``."""
    return first_rows_per_group(df, n, [order], [group]).drop("rank")


def filter_groups(df: DataFrame, group: str, names: list[str] | None = None) -> DataFrame:
    """All groups, or the named ones; unknown names are ignored."""
    return df if names is None else df.where(F.col(group).isin(list(names)))


def quantile_exemplars(df: DataFrame, metric: str, order_key: str) -> DataFrame:
    """P5: the rows at n//4, n//2 and 3n//4 by ``metric``, ties by ``order_key``. Adds ``exemplar``."""
    names: dict[int, list[str]] = {}

    def positions(n: int) -> list[int]:
        for name, at in (("short", n // 4), ("medium", n // 2), ("long", n * 3 // 4)):
            names.setdefault(at, []).append(name)
        return list(names)

    keys = df.select(metric, order_key)
    picked = rows_at(keys, [metric, order_key], positions)
    if picked is None:
        ranks = ranked_rows(keys, [metric, order_key])
        positions(ranks.count())
        picked = ranks.withColumn("position", F.col("rank") - 1).where(F.col("position").isin(list(names)))
    named = df.sparkSession.createDataFrame([(at, n) for at, some in names.items() for n in some], "position long, exemplar string")
    picked = picked.join(F.broadcast(named), "position").select(order_key, "exemplar")
    return df.join(F.broadcast(picked), order_key)  # three rows at most
