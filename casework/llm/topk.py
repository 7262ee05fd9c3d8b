"""Exact top-k inner products by block-at-a-time pruning.

Vectors become integers. Each task holds a range of documents cut into blocks; a block keeps the largest
and smallest value of each term (dimension) and a forward index, the vectors themselves. For each query
the bound of a block is the sum of what each term can add at most. Blocks are scored in the order of
their bounds until the bound falls below the k-th best score, so nothing that could enter is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm.vectors import matrix, whole

#: Documents of a task and queries that meet them there, and documents of a block.
SHARD, QUERY_BLOCK, BLOCK = 32_768, 16_384, 64
LEAST_SHARDS = 8
#: Integers that doubles hold exactly.
EXACT = 2**53


def quantised(vectors: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * vectors)


def near_order(vectors: np.ndarray) -> np.ndarray:
    """An order that brings alike vectors together: by the signs of the terms that vary most."""
    widest = np.argsort(-vectors.var(0), kind="stable")[:16]
    return np.lexsort((vectors[:, widest] > 0).T[::-1])


def block_top_k(queries: np.ndarray, own: np.ndarray, docs: np.ndarray, ids: np.ndarray, k: int):
    """Rows of ``queries``, ids and scores of each query's k best documents; ties to the smaller id.

    ``own`` is the id that a query does not take. Rounds take twice as many blocks each, so that a block
    is scored once for all the queries that want it in the round.
    """
    order = near_order(docs.astype(np.float64))
    docs, ids = docs[order], ids[order]
    starts = np.arange(0, len(docs), BLOCK)
    high = np.maximum.reduceat(docs, starts, axis=0)
    low = np.minimum.reduceat(docs, starts, axis=0)
    bound = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    ranked = np.argsort(-bound, axis=1, kind="stable")
    everyone = np.arange(len(queries))
    kth = np.full(len(queries), -np.inf, dtype=bound.dtype)
    best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bound.dtype)
    first, width = 0, 1
    while first < len(starts):
        wanted = ranked[:, first : first + width]
        query = np.repeat(everyone, wanted.shape[1])
        block = wanted.ravel()
        open_ = bound[query, block] >= kth[query]  # an equal bound may hold a tie with a smaller id
        query, block = query[open_], block[open_]
        if not len(query):
            break
        by_block = np.argsort(block, kind="stable")
        query, block = query[by_block], block[by_block]
        edges = np.flatnonzero(np.diff(block)) + 1
        found = [best]
        for part in np.split(np.arange(len(query)), edges):
            rows, at = query[part], int(starts[block[part[0]]])
            scores = queries[rows] @ docs[at : at + BLOCK].T
            take = (scores >= kth[rows][:, None]) & (ids[at : at + BLOCK][None] != own[rows][:, None])
            i, j = np.nonzero(take)
            found.append((rows[i], ids[at + j], scores[i, j]))
        row, name, score = (np.concatenate(x) for x in zip(*found, strict=True))
        kept = np.lexsort((name, -score, row))
        row, name, score = row[kept], name[kept], score[kept]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < k
        best = row[kept], name[kept], score[kept]
        full = best[0][place[kept] == k - 1]
        kth[full] = best[2][place[kept] == k - 1]
        first, width = first + width, width * 2
    return best


def top_k(
    vectors: DataFrame,
    every: int = 50,
    k: int = 5,
    scale: float = 256.0,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best integer inner products of each query with all rows.

    Queries are rows whose key is divisible by ``every``; candidates are all rows with another key.
    Components become floor(scale * x). Fewer than k candidates give fewer rows; ties go to the smaller
    key. Rows that are null, empty, hold a null or non-finite component, or have no key take no part. Vectors
    meet only those of their own length. Rows that repeat are candidates each; of a query key that
    repeats, the smallest vector asks. An empty table gives no rows.

    Documents are dealt to tasks by a hash of the key, SHARD at a time, and queries go to each in blocks of
    QUERY_BLOCK, so a task is bounded at any size; each passes on k rows a query. Scores are computed in
    doubles where those are exact, in whole numbers of any size
    elsewhere; a score beyond 64 bits is an error.
    """
    valid = vectors.where(whole(vector) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.size(vector).alias("dim")
    )
    asked = valid.where(F.col("id") % every == 0).groupBy("id", "dim").agg(F.min("v").alias("v"))
    count, queries = valid.agg(F.count("*"), F.count(F.when(F.col("id") % every == 0, 1))).first()
    shards = max(LEAST_SHARDS, -(-count // SHARD))
    parts = max(1, -(-queries // QUERY_BLOCK))
    all_parts = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    all_shards = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    mine = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")
    part = F.pmod(F.xxhash64("id", F.lit("part")), F.lit(parts)).cast("int").alias("part")
    docs = valid.select("dim", mine, "id", "v", F.lit(False).alias("asks"), all_parts)
    asking = asked.select("dim", part, "id", "v", F.lit(True).alias("asks"), all_shards)
    met = docs.unionByName(asking)

    def search(group: tuple, table: pa.Table) -> pa.Table:
        dim = group[0].as_py()
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        ids = table.column("id").to_numpy()
        values = quantised(matrix(table.column("v"), dim), scale)
        most = float(np.abs(values).max(initial=0.0))
        if most * most * max(dim, 1) >= EXACT:
            values = np.array([[int(x) for x in row] for row in values], object).reshape(values.shape)
        if dim and asks.any() and not asks.all():
            row, name, score = block_top_k(values[asks], ids[asks], values[~asks], ids[~asks], k)
            out = ids[asks][row], name, score.astype(np.int64)
        else:
            out = [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, out), strict=True)))

    best = met.groupBy("dim", "shard", "part").applyInArrow(search, "query_id long, vec_id long, score long")
    order = "row_number() over (partition by query_id order by score desc, vec_id)"
    ranked = best.withColumn("rank", F.expr(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
