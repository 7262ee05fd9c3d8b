"""Connected components of a graph given as edges, by alternating star contractions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.session import remove, written


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node long, component long``: the smallest node reachable from each node that has an edge.

    Each round is two groupings with map-side combine and two joins on the same keys; only edges move,
    never a list of a node's neighbours, so a hub is a skewed join at most. Rounds grow with the
    logarithm of the longest path. Each round is written to the shared folder, so a lost executor costs
    one round, and the round before is deleted. Null ends and loops are no edges. No edges: no rows.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent"))
    pairs = pairs.where("child > parent").distinct()
    now, path = written(pairs, "edges")
    before = _fingerprint(now)
    while before[0]:
        both = now.unionAll(now.select(F.col("parent").alias("child"), F.col("child").alias("parent")))
        least = both.groupBy("child").agg(F.least(F.col("child"), F.min("parent")).alias("low"))
        large = both.where("parent > child").join(least, "child")
        large = large.select(F.col("parent").alias("child"), F.col("low").alias("parent"))
        # Leaves that are smaller than none of their neighbours keep the edge to their least neighbour.
        large = large.where("child > parent").distinct()
        low = large.groupBy("child").agg(F.min("parent").alias("low"))
        small = large.join(low, "child").where("parent > low")
        small = small.select(F.col("parent").alias("child"), F.col("low").alias("parent"))
        new, new_path = written(
            small.unionAll(low.withColumnRenamed("low", "parent")).distinct(), "edges"
        )
        after = _fingerprint(new)
        remove(spark, path)
        now, path = new, new_path
        if after == before:
            break
        before = after
    roots = now.select(F.col("parent").alias("node"), F.col("parent").alias("component")).distinct()
    return now.select(F.col("child").alias("node"), F.col("parent").alias("component")).unionAll(roots)
