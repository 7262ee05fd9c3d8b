"""Hard negatives by threshold joins in the manner of L2AP.

A search asks for the k best rows whose score with a query lies in a window. Vectors are dealt to cells
around pivots; a query goes to a cell only if the cell's bound reaches what the query still lacks. Where they
meet, an inverted index holds the dimensions of each vector behind its longest prefix that is too short to
reach the threshold alone; partial scores are accumulated over the index from the last dimension to the
first and pairs are dropped as soon as the norms of what remains cannot lift them to their threshold. The
threshold is lowered until the windows are full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.llm.vectors import matrix, whole
from casework.session import remove, written

#: Pivots at most, rows for each of them, rows of a cell that one task takes, and queries that meet them there.
PIVOTS, CELL_ROWS, PIECE_ROWS, PART_ROWS = 256, 2_048, 16_384, 4_096
#: Queries that are accumulated at once, and dimensions that are accumulated in one step.
QUERIES_AT_ONCE, STEP = 64, 8
#: How far below a window's top the threshold is, as a share of the window, round by round.
LOWERED = (0.125, 0.25, 0.375, 0.5, 1.0)
#: Components up to this have scores and norms that doubles hold exactly.
PLAIN = 2.0**20
LONGS = -(2**63), 2**63 - 1


def _reaches(bound: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether a bound computed in doubles may reach ``least``."""
    return bound + np.abs(bound) * 1e-9 + 1e-3 >= least


class SuffixIndex:
    """Postings by blocks of dimensions, without the prefixes whose norm is below ``level``."""

    def __init__(self, rows: np.ndarray, prefix: np.ndarray, level: float):
        #: Leading dimensions of each row that the index omits; a row that is omitted whole has no posting.
        self.start = (prefix[:, 1:] * (1 + 1e-9) < level).sum(1)
        self.postings = []
        for first in reversed(range(0, rows.shape[1], STEP)):
            dims = np.arange(first, min(first + STEP, rows.shape[1]))
            held = np.flatnonzero(self.start <= dims[-1])
            values = np.where(dims >= self.start[held][:, None], rows[np.ix_(held, dims)], 0.0)
            self.postings.append((dims, held, values))


def _joined(queries, q_prefix, least, allowed, rows, prefix, index):
    """Query rows, vector rows and scores of the allowed pairs whose score is ``least`` of the query or more."""
    alive = allowed & (index.start < rows.shape[1])
    partial = np.zeros(alive.shape)
    for dims, held, values in index.postings:
        wanted = alive[:, held].any(0)
        held = held[wanted]
        if not len(held):
            continue
        partial[:, held] += queries[:, dims] @ values[wanted].T
        rest = np.maximum(index.start[held], dims[0])  # dimensions before this are still to come
        bound = partial[:, held] + q_prefix[:, rest] * prefix[held, rest]
        alive[:, held] &= _reaches(bound, least[:, None])
    q, x = np.nonzero(alive)
    scores = np.empty(len(q))
    for at in range(0, len(q), 1 << 16):
        part = slice(at, at + (1 << 16))
        scores[part] = np.einsum("ij,ij->i", queries[q[part]], rows[x[part]])
    kept = scores >= least[q]
    return q[kept], x[kept], scores[kept]


def _best(q: np.ndarray, name: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query; ties to the smaller name."""
    order = np.lexsort((name, -score, q))
    place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
    return order[place < k]


def search_block(queries, rows, names, allowed, low, high, k):
    """Query, window, name and score of the k best allowed rows with a score in each window of each query.

    ``low`` and ``high`` are the windows (queries x windows; a window is empty where low is above high).
    Every score must be a whole number that doubles hold.
    """
    found = [[] for _ in range(4)]
    if not len(queries) or not len(rows):
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
    order = np.argsort(np.square(rows).sum(0), kind="stable")  # weak ones first: long prefixes, and little is left early
    queries, rows = queries[:, order], rows[:, order]
    q_prefix = np.sqrt(np.hstack([np.zeros((len(queries), 1)), np.square(queries).cumsum(1)]))
    prefix = np.sqrt(np.hstack([np.zeros((len(rows), 1)), np.square(rows).cumsum(1)]))
    reach = q_prefix[:, -1] * prefix[:, -1].max() + 1.0
    top = np.minimum(high, reach[:, None])
    floor = np.maximum(low, -reach[:, None])
    open_ = floor <= top
    for share in LOWERED:
        least = np.where(open_, np.ceil(top - share * (top - floor)) if share < 1 else floor, np.inf)
        lowest = least.min(1)
        asking = np.flatnonzero(open_.any(1))
        if not len(asking):
            break
        norms = q_prefix[asking, -1]
        level = np.where(lowest[asking] > 0, lowest[asking], 0.0) / np.where(norms > 0, norms, 1.0)
        asking = asking[np.argsort(-level, kind="stable")]
        for at in range(0, len(asking), QUERIES_AT_ONCE):
            some = asking[at : at + QUERIES_AT_ONCE]
            norm = q_prefix[some, -1]
            level = (np.maximum(lowest[some], 0.0) / np.where(norm > 0, norm, 1.0)).min()
            index = SuffixIndex(rows, prefix, level)
            q, x, score = _joined(queries[some], q_prefix[some], lowest[some], allowed(some), rows, prefix, index)
            for window in range(low.shape[1]):
                mine = some[q]
                inside = open_[mine, window] & (score >= least[mine, window]) & (score <= high[mine, window])
                taken = np.flatnonzero(inside)
                taken = taken[_best(q[taken], names[x[taken]], score[taken], k)]
                count = np.bincount(q[taken], minlength=len(some))
                full = (count >= k) | (share == 1.0)
                taken = taken[full[q[taken]]]
                for column, value in zip(found, (some[q[taken]], np.full(len(taken), window), names[x[taken]], score[taken]), strict=True):
                    column.append(value)
                open_[some[full], window] = False
    return [np.concatenate(column) if column else np.zeros(0, np.int64) for column in found]


def _search_large(queries, rows, names, allowed, low, high, k):
    """``search_block`` for components of any size, in Python's whole numbers, one query at a time."""
    found = [[] for _ in range(4)]
    exact = [[int(x) for x in row] for row in rows]
    for i, query in enumerate(queries):
        query = [int(x) for x in query]
        may = np.flatnonzero(allowed(np.array([i]))[0])
        scores = [(min(max(sum(a * b for a, b in zip(query, exact[j], strict=True)), LONGS[0]), LONGS[1]), j) for j in may]
        for window in range(low.shape[1]):
            inside = [(-s, int(names[j])) for s, j in scores if low[i, window] <= s <= high[i, window]]
            for score, name in sorted(inside)[:k]:
                for column, value in zip(found, (i, window, name, -score), strict=True):
                    column.append(value)
    return found


def _windows(column: pa.ChunkedArray, empty: int) -> np.ndarray:
    """Bounds of windows as a matrix; where a query has fewer windows than others, ``empty``."""
    bounds = column.to_pylist()
    out = np.full((len(bounds), max(map(len, bounds), default=0)), empty, np.int64)
    for row, values in zip(out, bounds, strict=True):
        row[: len(values)] = values
    return out


def _pivots(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Different vectors by length, at most PIVOTS in all, chosen by a hash of the key."""
    count = vectors.count()
    chosen = vectors.orderBy(F.xxhash64("id", F.lit("pivot")), "id").limit(max(1, min(PIVOTS, count // CELL_ROWS)))
    by: dict[int, list] = {}
    for row in chosen.select("dim", "v").collect():
        by.setdefault(row["dim"], []).append(row["v"])
    return {dim: np.unique(np.array(rows).reshape(len(rows), dim), axis=0) for dim, rows in by.items()}


def _in_cells(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``vectors`` with the cell of the nearest pivot of their length (the zero vector's, -1, if none) and the distance."""

    def run(batches):
        for batch in batches:
            dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
            column = batch.column(batch.schema.get_field_index("v"))
            cell, far = np.full(len(dims), -1, np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                rows = matrix(column.take(pa.array(at)), dim)
                known = pivots.get(int(dim))
                if known is not None:
                    apart = np.square(rows).sum(1)[:, None] - 2 * rows @ known.T + np.square(known).sum(1)
                    cell[at] = apart.argmin(1)
                    rows = rows - known[cell[at]]
                far[at] = np.sqrt(np.square(rows).sum(1))
            yield pa.record_batch([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    schema = type(vectors.schema)([*vectors.schema.fields]).add("cell", "integer").add("far", "double")
    return vectors.mapInArrow(run, schema)


def _sent(queries: DataFrame, pivots: dict[int, np.ndarray], cells: dict[int, dict[int, tuple[float, int]]], nearest: bool) -> DataFrame:
    """Each query once for every piece of every cell that may hold a row of one of its windows.

    ``cells`` has the radius and the number of pieces by length and cell; at most PIVOTS + 1 cells of a length.
    With ``nearest`` a query goes to one piece of the cell with the highest bound only.
    """

    def run(batches):
        for batch in batches:
            dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
            column = batch.column(batch.schema.get_field_index("v"))
            lows = batch.column(batch.schema.get_field_index("low")).to_pylist()
            highs = batch.column(batch.schema.get_field_index("high")).to_pylist()
            least = np.array([min((float(a) for a, b in zip(x, y, strict=True) if a <= b), default=np.inf) for x, y in zip(lows, highs, strict=True)])
            out = [[], [], []]
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                rows = matrix(column.take(pa.array(at)), dim)
                places = cells.get(int(dim), {})
                known = pivots.get(int(dim), np.zeros((0, dim)))
                centres = np.vstack([known, np.zeros((1, dim))])[[*places]]  # cell -1 is the last
                radius = np.array([r for r, _ in places.values()])
                count = np.array([n for _, n in places.values()], np.int64)
                bound = rows @ centres.T + np.sqrt(np.square(rows).sum(1))[:, None] * radius * (1 + 1e-9)
                open_ = _reaches(bound, least[at][:, None])
                if nearest and len(places):
                    open_ &= np.arange(len(places)) == bound.argmax(1)[:, None]
                i, j = np.nonzero(open_)
                times = np.ones(len(j), np.int64) if nearest else count[j]
                piece = np.arange(times.sum()) - np.repeat(times.cumsum() - times, times)
                for part, value in zip(out, (np.repeat(at[i], times), np.repeat(np.array([*places], np.int64)[j], times), piece), strict=True):
                    part.append(value)
            row, cell, piece = (np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32) for x in out)
            for first in range(0, len(row), 4_096):  # a batch may go to many pieces
                s = slice(first, first + 4_096)
                yield pa.record_batch(
                    [*(c.take(pa.array(row[s])) for c in batch.columns), pa.array(cell[s]), pa.array(piece[s])],
                    names=[*batch.schema.names, "cell", "piece"],
                )

    schema = type(queries.schema)([*queries.schema.fields]).add("cell", "integer").add("piece", "integer")
    return queries.mapInArrow(run, schema)


def _met(queries: DataFrame, vectors: DataFrame, same: bool, k: int) -> tuple[DataFrame, str]:
    """``id, place, name, score, rank``, written: the k best rows of each window in the pieces its query was sent to."""
    # Pieces that many queries want take them in parts, the rows once for each part.
    parts = queries.groupBy("dim", "cell", "piece").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    keys = ["dim", "cell", "piece"]
    asking = queries.join(parts, keys).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    rows = vectors.join(parts, keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = asking.select(*keys, "part", "id", "label", "v", "low", "high").unionByName(
        rows.select(*keys, "part", "id", "label", "v"), allowMissingColumns=True
    )

    def search(group: tuple, table: pa.Table) -> pa.Table:
        dim = group[0].as_py()
        asks = np.asarray(table.column("low").is_valid())
        ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
        out = [[] for _ in range(4)]
        if asks.any() and not asks.all():
            values = matrix(table.column("v"), dim)
            plain = np.abs(values).max(1, initial=0.0) < PLAIN
            asked = table.filter(pa.array(asks))
            low, high = _windows(asked.column("low"), 1), _windows(asked.column("high"), 0)
            one = np.flatnonzero(asks)
            for large_q in (False, True):
                for large_x in (False, True):
                    q = np.flatnonzero(plain[one] != large_q)
                    x = np.flatnonzero(~asks & (plain != large_x))
                    if not len(q) or not len(x):
                        continue

                    def allowed(some, q=one[q], x=x):
                        match = (labels[q[some]][:, None] == labels[x][None]) == same
                        return match & (ids[q[some]][:, None] != ids[x][None])

                    run = _search_large if large_q or large_x else search_block
                    at, place, name, score = run(values[one[q]], values[x], ids[x], allowed, low[q], high[q], k)
                    at = np.asarray(at, np.int64)
                    for column, value in zip(out, (ids[one[q]][at], place, name, score), strict=True):
                        column.append(np.asarray(value).astype(np.int64))
        columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.table(dict(zip(("id", "place", "name", "score"), map(pa.array, columns), strict=True)))

    found = both.groupBy(*keys, "part").applyInArrow(search, "id long, place long, name long, score long")
    order = "row_number() over (partition by id, place order by score desc, name)"
    found = found.withColumn("rank", F.expr(order)).where(F.col("rank") <= k)
    return written(found, "found")


def windowed_top_k(queries: DataFrame, vectors: DataFrame, pivots: dict, cells: dict, same: bool, k: int) -> DataFrame:
    """``id, place, rank, name, score``: the k best rows in each window of each query; ties to the smaller name.

    ``queries`` has ``id, label, dim, v, low, high`` (arrays of windows), ``vectors`` has ``dim, cell, piece, id,
    label, v``. A first search in each query's nearest piece finds a floor under the windows that it fills;
    only cells whose bound reaches a floor are searched then.
    """
    first, path = _met(_sent(queries, pivots, cells, True), vectors, same, k)
    last = first.where(F.col("rank") == k).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("kth"))
    raised = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("kth", i.cast("long")), x)))
    floored = queries.join(last, "id", "left").withColumn("low", F.when(F.col("kth").isNull(), F.col("low")).otherwise(raised))
    found, _ = _met(_sent(floored.drop("kth"), pivots, cells, False), vectors, same, k)
    remove(found.sparkSession, path)
    return found


def hard_negatives(
    vectors: DataFrame,
    label: Column | str = "label",
    every: int = 100,
    positives: int = 5,
    k: int = 5,
    least: int = 80,
    most: int = 100,
    scale: float = 256.0,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank``.

    Anchors are rows whose key is divisible by ``every``; an anchor's positives are its best other rows of
    the same label, its negatives the k best rows of other labels whose score is between ``least`` and
    ``most`` percent of the positive's (0 to 100; a negative positive score leaves no window). Scores are inner
    products of floor(scale * x); ties go to the smaller key. Fewer rows than asked for give fewer.

    Rows with a null key, label or vector or a null or non-finite component take no part; vectors meet only
    those of their own length. Rows that repeat a key are candidates each, but not for an anchor of that key;
    of an anchor key that repeats the smallest (label, vector) asks. Scores beyond 64 bits count as the
    nearest number of 64 bits. Further columns are ignored; an empty table gives no rows.

    Every task sees PIECE_ROWS rows and PART_ROWS anchors at most, about, whatever the sizes of labels and of
    groups of copies: a cell is cut into pieces by a hash of the key.
    """
    label = F.col(label) if isinstance(label, str) else label

    def floored(x):
        x = x.cast("double") * scale
        return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)  # beyond, all doubles are whole

    valid = vectors.where(whole(vector) & F.col(key).isNotNull() & label.isNotNull()).select(
        F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.size(vector).alias("dim"),
        F.transform(vector, floored).alias("v"),
    ).where(F.forall("v", lambda x: F.abs(x) < float("inf")))
    pivots = _pivots(valid)
    placed, path = written(_in_cells(valid, pivots), "cells")
    sizes = placed.groupBy("dim", "cell").agg(F.max("far").alias("radius"), F.ceil(F.count("*") / PIECE_ROWS).cast("int").alias("pieces"))
    cells: dict[int, dict] = {}
    for dim, cell, radius, pieces in sizes.collect():  # at most PIVOTS cells, and one for each further length
        cells.setdefault(dim, {})[cell] = radius, pieces
    pieces = [(dim, cell, n) for dim, places in cells.items() for cell, (_, n) in places.items()]
    pieces = vectors.sparkSession.createDataFrame(pieces, "dim int, cell int, pieces int")
    piece = F.pmod(F.xxhash64("id", F.lit("piece")), "pieces").cast("int").alias("piece")
    dealt = placed.join(F.broadcast(pieces), ["dim", "cell"]).select("dim", "cell", piece, "id", "label", "v")

    asked = valid.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("label", "v", "dim")).alias("row"))
    bounds = [F.array(F.lit(x).cast("long")).alias(name) for x, name in zip(LONGS, ("low", "high"), strict=True)]
    anchors, _ = written(asked.select("id", "row.*", *bounds), "anchors")
    best = windowed_top_k(anchors, dealt, pivots, cells, True, positives)
    best = best.select("id", F.col("rank").alias("positive_rank"), F.col("name").alias("positive_id"), F.col("score").alias("positive_score"))

    windows = best.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("positive_rank", "positive_score"))).alias("w"))

    # Whole numbers in decimals: 80 times a score of 64 bits has more bits.
    times = [F.expr(f"transform(w, x -> {f}(x.positive_score * {p}bd / 100bd))") for f, p in (("ceil", least), ("floor", most))]
    low, high = (x.cast("array<long>") for x in times)
    asking = anchors.drop("low", "high").join(windows, "id").select("id", "label", "v", "dim", low.alias("low"), high.alias("high"))
    found = windowed_top_k(asking, dealt, pivots, cells, False, k)
    found = found.withColumn("positive_rank", (F.col("place") + 1).cast("int"))
    rows = found.join(best, ["id", "positive_rank"]).select(
        F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("name").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"), "positive_rank",
    )
    rows, _ = written(rows, "negatives")
    remove(rows.sparkSession, path)
    return rows
