"""Exact quantiles: a mergeable sketch bounds each one, and only the values between the bounds are counted.

The first scan leaves one KLL sketch for each task and group; what it moves has the size of the sketches, however many
values differ. The second scan counts the rows below each bound and the values inside, which are a few in a
thousand of the ranks. The counts prove that the wanted ranks lie inside; where a sketch was wrong, which it is now and
then by its nature, all values of that group are counted.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from casework.operators.dimension import join_groups
from casework.operators.ranking import quantile, ranked_counts, ranked_values
from casework.session import checkpoint

#: Size of a sketch, and the share of the ranks that a bound is off at most, about three times what the size promises.
SKETCH, SLACK = 4_096, 0.004


def _bounded(df: DataFrame, value: str, by: list[str], shares: dict[str, float], extra: list[Column]) -> DataFrame:
    """One row per group: rows, further aggregates, and for each quantile its ranks and the bounds of its values."""
    number = F.col(value).cast("double")
    groups = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_total"), F.min(value).alias("_least"), F.max(value).alias("_most"),
        F.kll_sketch_agg_double(F.when(~F.isnan(number), number), F.lit(SKETCH)).alias("_sketch"), *extra,
    ).where(F.col("_total") > 0)
    # Small groups are counted whole; so are those with NaN, which is the greatest value and in no sketch.
    large = (F.col("_total") > 8 * SKETCH) & (F.kll_sketch_get_n_double("_sketch") == F.col("_total"))
    asked = []
    for name, share in shares.items():
        at = (F.col("_total") - 1) * F.lit(float(share))
        ranks = [F.floor(at).cast("long").alias("low_rank"), F.ceil(at).cast("long").alias("high_rank")]
        lower, upper = F.col("_least").cast("double"), F.col("_most").cast("double")
        if share > SLACK:
            lower = F.when(large, F.kll_sketch_get_quantile_double("_sketch", F.lit(share - SLACK))).otherwise(lower)
        if share < 1 - SLACK:
            upper = F.when(large, F.kll_sketch_get_quantile_double("_sketch", F.lit(share + SLACK))).otherwise(upper)
        asked.append(F.struct(F.lit(name).alias("name"), *ranks, lower.alias("lower"), upper.alias("upper")))
    return groups.withColumn("_asked", F.array(*asked)).drop("_sketch", "_least", "_most")


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys that may be NULL; sides are counts, whose sizes adaptive execution sees."""
    right = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return left.join(right, same, how).drop(*[f"_of_{k}" for k in keys])


def exact_quantiles(
    df: DataFrame, value: str, by: list[str], shares: dict[str, float], extra: list[Column] = ()
) -> DataFrame:
    """The quantiles of a column per group, interpolated linearly, with further aggregates of the same scan.

    Columns: ``by``, ``total`` (rows that are not NULL), one double for each of ``shares`` (name -> share of the way from
    the smallest to the largest rank) and ``extra``. Groups without a value have no row.
    """
    by, one = list(by), "_all"
    keys = by or [one]  # joins need a key
    rows = df.where(F.col(value).isNotNull())
    rows = rows if by else rows.withColumn(one, F.lit(0))
    groups = checkpoint(_bounded(rows, value, keys, shares, list(extra)))
    number = F.col(value).cast("double")
    near = join_groups(rows.select(*keys, value), groups.select(*keys, "_asked"), keys)
    near = near.select(*keys, value, F.explode("_asked").alias("_a"))
    # Every value below the bounds counts as one, NULL; what is above them is of no interest.
    inside = F.when(number >= F.col("_a.lower"), F.col(value))
    near = near.where(number <= F.col("_a.upper")).select(*keys, F.col("_a.name").alias("_name"), inside.alias(value))
    counts = checkpoint(near.groupBy(*keys, "_name", value).agg(F.count(F.lit(1)).alias("n")))
    of = [*keys, "_name"]
    sides = counts.groupBy(*of).agg(
        F.coalesce(F.sum(F.when(F.col(value).isNull(), F.col("n"))), F.lit(0)).alias("_below"),
        F.coalesce(F.sum(F.when(F.col(value).isNotNull(), F.col("n"))), F.lit(0)).alias("_inside"),
    )
    ranks = groups.select(*keys, "_total", F.explode("_asked").alias("_a"))
    ranks = ranks.select(*keys, "_total", F.col("_a.name").alias("_name"), "_a.low_rank", "_a.high_rank")
    sound = (F.col("_below") <= F.col("low_rank")) & (F.col("high_rank") < F.col("_below") + F.col("_inside"))
    checked = _joined(ranks, sides, of, "left").withColumn("_sound", F.coalesce(sound, F.lit(False)))
    ranked = ranked_counts(counts.where(F.col(value).isNotNull()), value, of).drop("total")
    known = _joined(ranked, checked.where("_sound").select(*of, "_below", F.col("_total").alias("total")), of)
    known = known.withColumn("below", F.col("below") + F.col("_below")).drop("_below")
    missed = checked.where("not _sound").select(*keys).distinct()
    if not missed.isEmpty():
        again = ranked_values(_joined(rows.select(*keys, value), missed, keys), value, keys)
        names = F.explode(F.array(*[F.lit(name) for name in shares])).alias("_name")
        left = _joined(again.select("*", names), checked.where("not _sound").select(*of), of)
        known = known.unionByName(left.select(*known.columns))
    found = known.groupBy(*of).agg(*[quantile(value, q).alias(f"_{name}") for name, q in shares.items()])
    # Each quantile has rows of its own, so of all these only the one of its name means something.
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col(f"_{name}"))).alias(name) for name in shares])
    out = _joined(groups.drop("_asked"), wide, keys).withColumnRenamed("_total", "total")
    return out if by else out.drop(one)
