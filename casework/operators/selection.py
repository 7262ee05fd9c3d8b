"""Rows at given ranks, found by counts that narrow down where they are.

Values are mapped to numbers in an order-preserving way and counted per bucket of their range; only buckets that
hold a wanted rank are looked into, with buckets of their own, until each holds few rows. Those are ranked, and
nothing else is: no row is sorted or written for the count, and a count moves at most BUCKETS rows per task and
bucket that is looked into.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

#: Buckets of a range, rows that are few enough to be ranked at once, and pieces of a text that are compared in turn.
BUCKETS, FEW, PIECES = 4_096, 65_536, 8
#: Bytes of a piece: numbers of six bytes are exact in a double.
PIECE = 6
NUMBERS = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _codes(df: DataFrame, name: str) -> list[Column] | None:
    """Numbers that are in the order of the column, compared one after another; NULL first and NaN last, as Spark
    sorts. Different values may share them."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    if isinstance(kind, T.StringType) and kind.simpleString() == "string":

        def piece(i: int) -> Column:
            some = F.rpad(F.hex(F.substring(c.cast("binary"), i * PIECE + 1, PIECE)), 2 * PIECE, "0")
            return F.coalesce(F.conv(some, 16, 10).cast("double"), low)

        return [piece(i) for i in range(PIECES)]
    if not isinstance(kind, NUMBERS):
        return None
    if isinstance(kind, T.DateType):
        c = F.unix_date(c)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        c = F.unix_micros(c.cast("timestamp"))
    elif isinstance(kind, T.BooleanType):
        c = c.cast("int")
    number = c.cast("double")
    return [F.coalesce(F.when(F.isnan(number), high).otherwise(number), low)]


def _bucket(code: Column) -> Column:
    """The bucket of a number in the finite range ``lo`` to ``hi``; -1 and BUCKETS for infinite ones."""
    low, high = F.col("_lo") / 2, F.col("_hi") / 2  # halves, as the whole range may be no finite number
    share = (code / 2 - low) / (high - low)
    inside = F.when(high > low, F.least(F.floor(share * BUCKETS).cast("int"), F.lit(BUCKETS - 1))).otherwise(0)
    return F.when(code == float("-inf"), -1).when(code == float("inf"), BUCKETS).otherwise(inside)


def _finite(code: Column) -> Column:
    return F.when(F.abs(code) < float("inf"), code)


def rows_at(df: DataFrame, order: list[str], positions: list[int] | Callable[[int], list[int]]) -> DataFrame | None:
    """The ``order`` columns of the rows at ``positions`` (from 0) with their ``position``; out of range is skipped.

    ``order`` is unique. ``positions`` may be worked out from the number of rows. The driver sees a row for each
    wanted position and round. None where a column's type has no numbers in its order.
    """
    spark = df.sparkSession
    found = [_codes(df, name) for name in order]
    if any(c is None for c in found):
        return None
    codes = [c for column in found for c in column]
    rows = df.select(*order, F.array(*codes).alias("_codes"), F.lit(0).alias("_node"))
    first = _finite(F.get("_codes", F.lit(0)))
    total, low, high = rows.agg(F.count(F.lit(1)), F.min(first), F.max(first)).first()
    positions = positions(total) if callable(positions) else positions
    wanted = sorted({int(p) for p in positions if 0 <= p < total})
    #: node -> code it is parted by (None: few rows), range, rows before it, wanted positions
    nodes = {0: (0 if total > FEW else None, low, high, 0, wanted)} if wanted else {}
    while any(node[0] is not None for node in nodes.values()):
        inside = spark.createDataFrame(
            [(k, code, float(lo or 0.0), float(hi or 0.0)) for k, (code, lo, hi, _, _) in nodes.items()],
            "_node int, _code int, _lo double, _hi double",
        )
        asked = spark.createDataFrame(
            [(k, p - before) for k, (_, _, _, before, own) in nodes.items() for p in own], "_node int, _place long"
        )
        code = F.get("_codes", F.col("_code"))
        following = _finite(F.get("_codes", F.col("_code") + 1))
        parted = rows.join(F.broadcast(inside), "_node").withColumn("_bucket", F.when(F.col("_code").isNull(), 0).otherwise(_bucket(code)))
        counts = parted.groupBy("_node", "_bucket").agg(
            F.count(F.lit(1)).alias("_n"), F.min(_finite(code)).alias("_low"), F.max(_finite(code)).alias("_high"),
            F.min(following).alias("_next_low"), F.max(following).alias("_next_high"),
        )
        before = Window.partitionBy("_node").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        hit = counts.join(F.broadcast(asked), "_node")
        hit = hit.where((F.col("_before") <= F.col("_place")) & (F.col("_place") < F.col("_before") + F.col("_n")))
        hit = hit.groupBy(*counts.columns).agg(F.collect_list("_place").alias("_places")).collect()
        after, ways = {}, []
        for row in hit:
            at, _, _, start, _ = nodes[row["_node"]]
            own = [start + place for place in row["_places"]]
            alike = row["_low"] is None or row["_low"] / 2 == row["_high"] / 2
            if at is None or row["_n"] <= FEW or (alike and at + 1 == len(codes)):
                place = (None, 0.0, 0.0)
            elif alike:  # one number: the next one parts it
                place = (at + 1, row["_next_low"], row["_next_high"])
            else:
                place = (at, row["_low"], row["_high"])
            ways.append((row["_node"], row["_bucket"], len(after)))
            after[len(after)] = (*place, start + row["_before"], own)
        ways = spark.createDataFrame(ways, "_node int, _bucket int, _to int")
        rows = parted.join(F.broadcast(ways), ["_node", "_bucket"]).select(*order, "_codes", F.col("_to").alias("_node"))
        nodes = after
    asked = spark.createDataFrame(
        [(k, p - before + 1, p) for k, (_, _, _, before, own) in nodes.items() for p in own],
        "_node int, _rank int, position long",
    )
    inside = Window.partitionBy("_node").orderBy(*order)
    ranked = rows.withColumn("_rank", F.row_number().over(inside))
    return ranked.join(F.broadcast(asked), ["_node", "_rank"]).select(*order, "position")
