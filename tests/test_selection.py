"""Ranks found by narrowing counts and quantiles between sketched bounds, against sorted lists."""

import math
import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from casework.operators import profiling, quantiles, sampling, selection
from casework.operators.quantiles import exact_quantiles
from casework.operators.selection import rows_at


@pytest.fixture(params=[(8, 5)])
def narrow(request, monkeypatch):
    monkeypatch.setattr(selection, "BUCKETS", request.param[0])
    monkeypatch.setattr(selection, "FEW", request.param[1])


RNG = random.Random(2)
COLUMNS = {
    "long": [*{RNG.randrange(-(10**6), 10**6) for _ in range(150)}, 2**62, 2**62 + 1, 2**62 + 2, -(2**62), None],
    "double": [*(RNG.gauss(0, 1) for _ in range(150)), 1e308, -1e308, 5e-324, 0.0, math.inf, -math.inf, math.nan, None],
    "string": [*{"".join(RNG.choices("ab\x00Éz", k=RNG.randint(0, 14))) for _ in range(150)}, "a" * 60, "a" * 60 + "b", "a" * 60 + "a", None],
    "date": [date(2000, 1, 1) + timedelta(days=n * n) for n in range(120)] + [None],
    "timestamp": [datetime(2000, 1, 1) + timedelta(seconds=n**4, microseconds=n) for n in range(120)] + [None],
    "decimal(30,2)": [Decimal(n) / 4 * 10**20 for n in range(-60, 60)] + [None],
    "boolean": [True, False, None],
}


@pytest.mark.parametrize("kind", COLUMNS)
def test_positions_of_every_type(spark, narrow, kind):
    values = COLUMNS[kind][:]
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}").repartition(3)
    ordered = [r["v"] for r in df.orderBy("v").collect()]
    wanted = [0, 1, 2, len(values) // 2, len(values) - 2, len(values) - 1, len(values), -1]
    found = {r["position"]: r["v"] for r in rows_at(df, ["v"], wanted).collect()}
    assert set(found) == {p for p in wanted if 0 <= p < len(values)}
    assert all(repr(found[p]) == repr(ordered[p]) for p in found)


def test_ties_go_by_the_next_column(spark, narrow):
    data = [(RNG.choice([0.0, 0.5, None, 7.5]), f"k{i:03}") for i in range(200)]
    df = spark.createDataFrame(data, "m double, k string").repartition(4)
    ordered = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0.0, r[1]))
    found = rows_at(df, ["m", "k"], lambda n: [*range(0, n, 9)]).collect()
    assert sorted(r["position"] for r in found) == [*range(0, 200, 9)]
    assert all((r["m"], r["k"]) == ordered[r["position"]] for r in found)


def test_nothing_wanted_and_no_rows(spark, narrow):
    df = spark.range(5).select(F.col("id").alias("v"))
    assert rows_at(df, ["v"], []).count() == 0 and rows_at(df.where("v > 9"), ["v"], [0]).count() == 0
    assert sampling.quantile_exemplars(df.where("v > 9").withColumn("m", F.col("v")), "m", "v").count() == 0
    arrays = df.select(F.array("v").alias("a"))
    assert rows_at(arrays, ["a"], [1]) is None
    assert [r["position"] for r in sampling.take_positions(arrays, "a", [3, 1]).orderBy("position").collect()] == [1, 3]


def test_no_sort_and_no_copy_of_the_keys(spark, narrow):
    df = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("v"), F.lit("x").alias("more"))
    taken = sampling.take_positions(df, "v", [5, 2998])
    plan = taken._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and "Scan ExistingRDD" not in plan and "Sort" not in plan.replace("SortOrder", "")
    assert sorted(tuple(r) for r in taken.collect()) == [(5, "x", 5), (2998, "x", 2998)]


def expected(values, share):
    values = sorted(values, key=lambda v: (math.isnan(v), v))
    at = (len(values) - 1) * share
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


@pytest.mark.parametrize("sketch, slack", [(4096, 0.004), (8, 0.01), (8, 0.0)])
def test_quantiles_whatever_the_sketch_says(spark, monkeypatch, sketch, slack):
    monkeypatch.setattr(quantiles, "SKETCH", sketch)
    monkeypatch.setattr(quantiles, "SLACK", slack)
    rng = np.random.default_rng(3)
    groups = {"hot": rng.normal(size=3000), None: rng.integers(0, 4, 300).astype(float), "one": np.array([2.5]), "two": np.array([1.0, 4.0])}
    groups["nan"] = np.array([1.0, math.nan, 3.0, math.nan])
    data = [(g, float(v)) for g, values in groups.items() for v in values] + [("hot", None), ("empty", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    shares = {"a": 0.0, "q1": 0.25, "half": 0.5, "most": 0.99, "z": 1.0}
    found = {r["g"]: r for r in exact_quantiles(df, "v", ["g"], shares, [F.sum("v").alias("sum")]).collect()}
    assert set(found) == set(groups)
    for g, values in groups.items():
        assert found[g]["total"] == len(values)
        for name, share in shares.items():
            assert found[g][name] == pytest.approx(expected(values.tolist(), share), nan_ok=True), (g, name)


def test_quantiles_of_a_whole_table(spark):
    df = spark.createDataFrame([(i * i % 101,) for i in range(1000)], "v int")
    row = profiling.numeric_stats(df, "v").first()
    values = [i * i % 101 for i in range(1000)]
    assert (row["median"], row["min"], row["max"]) == (np.median(values), min(values), max(values))
    assert row["mean"] == pytest.approx(np.mean(values))
    assert profiling.numeric_stats(df.where("v > 500"), "v").first()["median"] is None


def test_only_values_between_the_bounds_are_moved(spark, monkeypatch):
    counted = []
    inner = quantiles.ranked_counts
    monkeypatch.setattr(quantiles, "ranked_counts", lambda counts, *rest: counted.append(counts.count()) or inner(counts, *rest))
    df = spark.range(100_000).select((F.hash("id") / 7.0).alias("v"))
    row = exact_quantiles(df, "v", [], {"half": 0.5}).first()
    assert row["total"] == 100_000 and 0 < counted[0] < 2_000
    assert row["half"] == df.agg(F.percentile("v", 0.5)).first()[0]
