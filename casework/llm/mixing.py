"""Mixing sources to target weights by Pfair scheduling.

A source of weight w releases its block j (from 0) at slot floor(j / w) and has to be served before slot
ceil((j + 1) / w). In each slot the released block with the earliest deadline is next. As weights sum to
one, every deadline is met, and at every slot each source is less than one block away from its share.
Weights are taken as the exact fractions they are, so this holds for a table of any length and any number of
sources. The driver goes through the blocks, not the documents, and holds PLANNED of them at once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.llm.names import set_apart
from casework.session import scratch_path

#: Slots of a period, for schedules that are to repeat.
PERIOD = 4_096
#: Documents of a block, and rows of a source that one task numbers, about.
BLOCK, RANGE = 16, 4_096
#: Blocks of the plan that the driver holds, and blocks up to which the plan is sent to all.
PLANNED, SENT = 500_000, 100_000


def shares(weights: Mapping[str | None, float], period: int = PERIOD) -> dict[str | None, int]:
    """Weights rounded to whole slots of a period, by largest remainder; each source has one slot at least."""
    if len(weights) > period:
        raise ValueError(f"more than {period} sources; choose a longer period")
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be above zero")
    total = sum(weights.values())
    exact = {s: w / total * (period - len(weights)) for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s is not None, s))
    for source in by_rest[: period - sum(out.values())]:
        out[source] += 1
    return out


def turns(weights: Mapping[str | None, object], blocks: Mapping[str | None, int]) -> Iterator[tuple[int, int, int]]:
    """(source's place by name, block, slot) of all blocks in order of slots, for exact weights.

    Where the block after a source's last one would come, the slot stays empty, (place, -1, slot), and the source
    leaves; slots in which no block of the others is released yet are closed up from then on.
    """
    names = sorted(weights, key=lambda s: (s is not None, s))
    exact = [Fraction(weights[s]) for s in names]
    if any(not w > 0 for w in exact):
        raise ValueError("weights must be above zero")
    common = lcm(*(w.denominator for w in exact))
    parts = [int(w * common) for w in exact]
    total = sum(parts)
    waiting = [(0, i, 0) for i in range(len(names))]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    now = slot = 0
    while waiting or ready:
        if not ready:
            now = max(now, waiting[0][0])
        while waiting and waiting[0][0] <= now:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // parts[i]), i, j))
        _, i, j = heapq.heappop(ready)
        if j < blocks[names[i]]:
            yield i, j, slot
            heapq.heappush(waiting, ((j + 1) * total // parts[i], i, j + 1))
        else:
            yield i, -1, slot
        now, slot = now + 1, slot + 1


def schedule(slots: Mapping[str | None, int]) -> list[tuple[str | None, int]]:
    """(source, block) of each slot of one period, earliest deadline first among released blocks."""
    names = sorted(slots, key=lambda s: (s is not None, s))
    return [(names[i], j) for i, j, _ in islice(turns(slots, slots), sum(slots.values()))]


def _plan(spark: SparkSession, weights: Mapping, blocks: Mapping[str | None, int]) -> tuple[DataFrame, int]:
    """``_name, _none, mix_block, mix_slot`` of all blocks, and the first slot that stays empty."""
    names = sorted(weights, key=lambda s: (s is not None, s))
    texts = pa.array(["" if s is None else str(s) for s in names], pa.string())
    end, path, all_turns = None, None, turns(weights, blocks)
    while part := [*islice(all_turns, PLANNED)]:
        at = np.array(part, np.int64)
        empty = at[:, 1] < 0
        if end is None and empty.any():
            end = int(at[empty][0, 2])
        at = at[~empty]
        none = pa.array([s is None for s in names]).take(pa.array(at[:, 0]))
        columns = [texts.take(pa.array(at[:, 0])), none, pa.array(at[:, 1]), pa.array(at[:, 2])]
        plan = spark.createDataFrame(
            pa.table(columns, names=["_name", "_none", "mix_block", "mix_slot"]),
            "_name string, _none boolean, mix_block long, mix_slot long",
        )
        if path is None and len(part) < PLANNED:
            return plan, end
        path = path or scratch_path(spark, "plan")
        plan.write.mode("append").parquet(path)
    return spark.read.schema(plan.schema).parquet(path), end


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    temperature: float = 0.7,
    block: int = BLOCK,
    seed: int = 0,
    period: int | None = None,
    key: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """All columns of ``docs`` with ``mix_block, mix_slot, mix_place, in_mix``.

    A source's documents are shuffled by a hash of ``seed`` and key and cut into blocks of ``block``.
    ``mix_slot`` is the block's place among all blocks, ``mix_place`` the document's in its block; ordered by
    both, each source is less than one block away from its exact weight. Every document gets a slot.
    ``in_mix`` is true up to the slot where the first source runs out (its last, shorter block counts): that
    part is the mixture at the target weights. A source that has run out leaves one slot empty and the
    schedule; the others go on in their weights' proportions.

    ``weights`` by source default to counts to the power of ``temperature``; sources without a weight stay
    out of the mix (null slot, ``in_mix`` false). A ``period`` rounds the weights to whole slots of it first
    (``shares``), so that the schedule repeats. A null source is a source of its own. Rows that repeat and
    null keys are documents like others; columns of the names above are replaced; an empty table gives no
    rows. Rows of a source are numbered in ranges of about RANGE by hash, so a hot source is spread; the
    driver holds a count for each source and PLANNED blocks, and takes a step for each block.
    """
    docs = docs.drop("mix_block", "mix_slot", "mix_place", "in_mix")
    docs, given = set_apart(docs, ["_name", "_none", "_hash", "_range", "_within", "_before", "_number", "_n"])
    key, source = given.get(key, key), given.get(source, source)
    mixed = _mixed(docs, weights, temperature, block, seed, period, key, source)
    return mixed.withColumnsRenamed({new: old for old, new in given.items()})


def _mixed(docs, weights, temperature, block, seed, period, key, source) -> DataFrame:
    """``mix`` of a table without columns of the names that it works with."""
    counts = dict(map(tuple, docs.groupBy(source).count().collect()))
    if weights is None:
        weights = {s: n**temperature for s, n in counts.items()}
    used = {s: weights[s] for s in counts if s in weights}
    if not used:
        nothing = F.lit(None).cast("long")
        return docs.select(
            "*", nothing.alias("mix_block"), nothing.alias("mix_slot"), nothing.alias("mix_place"),
            F.lit(False).alias("in_mix"),
        )
    blocks = {s: -(-counts[s] // block) for s in used}
    plan, end = _plan(docs.sparkSession, shares(used, period) if period else used, blocks)
    if sum(blocks.values()) <= SENT:
        plan = F.broadcast(plan)
    name = [F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_name"), F.col(source).isNull().alias("_none")]
    ranges = max(1, -(-max(counts.values()) // RANGE))
    numbered = docs.select("*", *name, F.xxhash64(F.lit(seed), key).alias("_hash")).withColumn(
        "_range", ((F.col("_hash") / 2.0**64 + 0.5) * ranges).cast("int")
    )
    # Where a source's ranges start: as many rows as sources times ranges, joined by the windows' own keys.
    before = numbered.groupBy("_name", "_none", "_range").agg(F.count("*").alias("_n")).selectExpr(
        "_name", "_none", "_range",
        "sum(_n) over (partition by _name, _none order by _range) - _n as _before",
    )
    within = f"row_number() over (partition by _name, _none, _range order by _hash, `{key}`) - 1"
    placed = numbered.withColumn("_within", F.expr(within)).join(before, ["_name", "_none", "_range"])
    number = F.col("_before") + F.col("_within")
    placed = placed.withColumn("_number", number).withColumn("mix_block", F.floor(number / block))
    # At most one row for each block, so at most ``block`` documents meet in a key.
    placed = placed.join(plan, ["_name", "_none", "mix_block"], "left")
    return placed.select(
        *docs.columns, "mix_block", "mix_slot", (F.col("_number") % block).alias("mix_place"),
        F.coalesce(F.col("mix_slot") < end, F.lit(False)).alias("in_mix"),
    )
