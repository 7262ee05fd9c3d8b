"""Near-duplicate vectors by product quantisation.

Vectors lie in coarse inverted lists, each as the codes of its residual's subspaces. A vector searches its
own list and those that may hold a neighbour: the plane between two centroids parts their lists, and a
neighbour at angle t lies at most sin(t) beyond it, sin(t) / sqrt(length) on an average. In a list,
distances come from lookup tables over the codes. The error of a code is known, so a pair is passed over
only if even that error could not lift it to the threshold; all others are compared exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm.components import components
from casework.llm.forest import Forest
from casework.llm.sampling import bounded
from casework.llm.vectors import matrix, whole
from casework.session import written

#: Vectors that centroids and codes are trained on at most, about; lists; codes of a subspace.
FIT_ROWS, LEAST_LISTS, MOST_LISTS, CODES = 10_000, 8, 1_024, 256
#: Vectors that a list should hold, and members of a list that one task takes.
LIST_SIZE, CHUNK = 512, 8_192
SUBSPACE, ROUNDS = 4, 8
#: Queries looked up at once, and what rounding can add to a product of unit vectors.
AT_ONCE, SLACK = 256, 1e-5


def k_means(points: np.ndarray, k: int, rounds: int, spherical: bool, seed: int) -> np.ndarray:
    """At most k centroids of the points."""
    rng = np.random.default_rng(seed)
    centres = points[np.sort(rng.choice(len(points), min(k, len(points)), replace=False))].copy()
    for _ in range(rounds):
        near = (points @ centres.T - (0 if spherical else (centres**2).sum(1) / 2)).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        count = np.bincount(near, minlength=len(centres))
        used = count > 0
        centres[used] = sums[used] / count[used, None]
        if spherical:
            norm = np.linalg.norm(centres, axis=1, keepdims=True)
            centres = np.where(norm > 0, centres / np.maximum(norm, 1e-300), centres)
    return centres


class ProductQuantiser:
    """Coarse centroids, and codebooks for the subspaces of what is left of a vector beside them."""

    def __init__(self, sample: np.ndarray, lists: int):
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.centres = k_means(unit, lists, ROUNDS, True, 1)
        rest = unit - self.centres[self.nearest(unit)]
        dim = unit.shape[1]
        self.spans = [(i, min(dim, i + SUBSPACE)) for i in range(0, dim, SUBSPACE)]
        self.books = [k_means(rest[:, i:j], CODES, ROUNDS, False, 2 + i) for i, j in self.spans]

    def nearest(self, unit: np.ndarray) -> np.ndarray:
        return (unit @ self.centres.T).argmax(1)

    def encode(self, unit: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each vector and the length of what they miss."""
        rest = unit - self.centres[lists]
        codes = np.zeros((len(unit), len(self.spans)), np.uint8)
        for m, ((i, j), book) in enumerate(zip(self.spans, self.books, strict=True)):
            part = rest[:, i:j]
            codes[:, m] = (part @ book.T - (book**2).sum(1) / 2).argmax(1)
            rest[:, i:j] = part - book[codes[:, m]]
        return codes, np.linalg.norm(rest, axis=1)

    def probes(self, unit: np.ndarray, lists: np.ndarray, cosine: float, reach: float | None) -> np.ndarray:
        """For each vector and list, whether the list may hold a vector of at least that cosine.

        ``reach`` is how many times the average distance a neighbour may lie beyond a plane; None is any.
        """
        sine = math.sqrt(max(0.0, 1 - cosine * cosine)) if cosine > 0 else 1.0
        if reach is not None:
            sine *= min(1.0, reach / math.sqrt(unit.shape[1]))
        product = unit @ self.centres.T
        beyond = product[np.arange(len(unit)), lists][:, None] - product
        apart = np.sqrt(np.maximum(2 - 2 * (self.centres @ self.centres.T), 0))[lists]
        # Nearest by product is nearest by angle for centroids of one length; a shorter one is always probed.
        even = np.abs((self.centres**2).sum(1) - 1) < 1e-9
        return (beyond <= sine * apart + SLACK) | ~even[None, :] | ~even[lists][:, None]

    def products(self, unit: np.ndarray, centre: int, codes: np.ndarray) -> np.ndarray:
        """Products of queries with the decoded members of a list, from lookup tables."""
        total = np.repeat((unit @ self.centres[centre]).astype(np.float32)[:, None], len(codes), axis=1)
        for m, ((i, j), book) in enumerate(zip(self.spans, self.books, strict=True)):
            table = (unit[:, i:j] @ book.T).astype(np.float32)
            total += table[:, codes[:, m]]
        return total


def _links(classes: DataFrame, dim: int, cosine: float, rows: int, reach: float | None) -> DataFrame:
    """``a, b, n``: edges (n null), and counts of linked vectors of a class (b null), for one length."""
    count = classes.count()
    sample = bounded(classes, "node", rows).select("v").toArrow()  # so many rows at most
    lists = min(MOST_LISTS, max(LEAST_LISTS, count // LIST_SIZE))
    quantiser = classes.sparkSession.sparkContext.broadcast(ProductQuantiser(matrix(sample.column(0), dim), lists))

    def unit_of(column):
        vectors = matrix(column, dim)
        vectors = vectors / np.abs(vectors).max(1, keepdims=True)  # so that no square runs over
        return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)

    def own_list(batches):
        for batch in batches:
            own = quantiser.value.nearest(unit_of(batch.column(1)))
            yield pa.record_batch([*batch.columns, pa.array(own.astype(np.int32))], names=["node", "v", "copies", "list"])

    kind = classes.schema["v"].dataType.simpleString()
    listed = classes.select("node", "v", "copies").mapInArrow(own_list, f"node long, v {kind}, copies long, list int")
    sizes = dict(listed.groupBy("list").count().collect())  # at most MOST_LISTS rows
    chunks = np.array([max(1, -(-sizes.get(i, 0) // CHUNK)) for i in range(lists)])

    def deal(batches):
        for batch in batches:
            unit, own = unit_of(batch.column(1)), batch.column(3).to_numpy()
            node = batch.column(0).to_numpy()
            to = quantiser.value.probes(unit, own, cosine, reach)
            to[np.arange(len(own)), own] = True
            # A pair from two lists meets in the smaller one.
            row, target = np.nonzero(to & (np.arange(to.shape[1])[None, :] <= own[:, None]))
            n = chunks[target]
            row, target = np.repeat(row, n), np.repeat(target, n)
            chunk = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            mine = (target == own[row]) & (chunk == node[row] % chunks[target])
            for at in range(0, len(row), 4096):
                part = slice(at, at + 4096)
                yield pa.record_batch(
                    [
                        pa.array(target[part].astype(np.int32)), pa.array(chunk[part].astype(np.int32)),
                        pa.array(mine[part]), *(c.take(pa.array(row[part])) for c in batch.columns),
                    ],
                    names=["at", "chunk", "member", "node", "v", "copies", "list"],
                )

    def search(group: tuple, table: pa.Table) -> pa.Table:
        at = group[0].as_py()
        pq = quantiser.value
        node = table.column("node").to_numpy()
        copies = table.column("copies").to_numpy()
        home = table.column("list").to_numpy()
        member = table.column("member").to_numpy(zero_copy_only=False)
        unit = unit_of(table.column("v"))
        rows = np.flatnonzero(member)
        codes, missed = pq.encode(unit[rows], np.full(len(rows), at))
        least = (cosine - missed - SLACK).astype(np.float32)
        forest = Forest(len(node))
        linked = np.zeros(len(node), np.int64)
        for start in range(0, len(node) if len(rows) else 0, AT_ONCE):
            part = np.arange(start, min(len(node), start + AT_ONCE))
            q, m = np.nonzero(pq.products(unit[part], at, codes) >= least)
            q, m = part[q], rows[m]
            once = (home[q] != at) | (node[q] < node[m])
            q, m = q[once], m[once]
            for i in range(0, len(q), 1 << 17):
                a, b = q[i : i + (1 << 17)], m[i : i + (1 << 17)]
                near = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
                a, b = a[near], b[near]
                np.add.at(linked, a, copies[b])
                np.add.at(linked, b, copies[a])
                forest.link(a, b)
        a, b = forest.edges()
        some = np.flatnonzero(linked)
        return pa.table(
            {
                "a": np.concatenate([node[a], node[some]]),
                "b": pa.array([*node[b].tolist(), *[None] * len(some)], pa.int64()),
                "n": pa.array([*[None] * len(a), *linked[some].tolist()], pa.int64()),
            }
        )

    dealt = listed.mapInArrow(
        deal, f"at int, chunk int, member boolean, node long, v {kind}, copies long, list int"
    )
    return dealt.groupBy("at", "chunk").applyInArrow(search, "a long, b long, n long")


def near_vectors(
    vectors: DataFrame,
    cosine: float = 0.95,
    key: str = "vec_id",
    vector: str = "embedding",
    rows: int = FIT_ROWS,
    reach: float | None = 3.0,
) -> DataFrame:
    """``key, n_links, component_id, kept`` of every row: vectors linked by at least ``cosine``.

    No link below ``cosine`` is made. With ``reach`` None no link is lost either; the default searches lists
    up to three times the average distance beyond their plane and found every link of the test tables.
    Centroids and codes are trained on about ``rows`` vectors at most; all vectors are indexed and compared.
    Equal vectors are one class from the start. ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest key that links reach, ``kept`` marks it. Rows without a key, null and
    zero vectors, and those with null or non-finite components link with nothing and stay (``kept`` is false
    without a key). Vectors meet only those of their own length. Rows that repeat are vectors of their own;
    further columns are ignored; an empty table gives no rows.

    A list with many vectors is cut into chunks of CHUNK members. Counting the links of a group whose
    vectors all differ takes the square of its size in comparisons, but never in rows.
    """
    given = vectors.schema[vector].dataType.simpleString()
    kind = given if given in ("array<float>", "array<double>") else "array<double>"  # floats are half the size
    rows_ = vectors.select(F.col(key).alias("id"), F.col(vector).cast(kind).alias("v"))
    valid = whole("v") & F.col("id").isNotNull() & F.exists("v", lambda x: x != 0)
    used = rows_.where(valid)
    classes = used.groupBy("v").agg(F.min("id").cast("long").alias("node"), F.count("*").alias("copies"))
    classes, _ = written(classes, "vectors")
    found = None
    for (dim,) in classes.select(F.size("v")).distinct().orderBy("size(v)").collect():
        part = _links(classes.where(F.size("v") == dim), dim, cosine, rows, reach)
        found = part if found is None else found.unionAll(part)
    same = F.col("id").cast("long")
    if found is None:
        return rows_.select(
            F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), same.alias("component_id"),
            F.col("id").isNotNull().alias("kept"),
        )
    found, _ = written(found, "links")
    named = components(found.where("b is not null"))
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
    known = classes.join(counts, "node", "left").join(named, "node", "left").select(
        "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"),
        F.coalesce("component", "node").alias("component_id"),
    )
    out = rows_.withColumn("v", F.when(valid, F.col("v"))).join(known, "v", "left")
    component = F.coalesce("component_id", same)
    return out.select(
        F.col("id").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(same == component, F.lit(False)).alias("kept"),
    )
