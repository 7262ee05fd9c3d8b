"""Totals over grouped rows."""

from pyspark.sql import Column, DataFrame, functions as F


def totals(grouped: DataFrame, **aggregates: Column) -> Column:
    """Aggregates over all groups as one struct, as a scalar subquery: no join with the grouped rows.

    Every column of ``grouped`` is read here, so the grouping is the same plan in both places and its
    shuffle runs once.
    """
    kept = [F.count(F.col(name)).alias(f"_{name}") for name in grouped.columns]
    named = [column.alias(name) for name, column in aggregates.items()]
    return grouped.agg(F.struct(*named, *kept)).scalar()
