"""Best-fit packing with capacities for tokens, documents and attention cost."""

from __future__ import annotations

import zlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm.token_counts import vocabulary

#: Rows of the table for each group that is packed on its own. A group ends with one open sequence or two.
ROWS_PER_GROUP = 4_096


def pieces(
    docs: DataFrame, size: int, end_id: int, path: str | None, key: str, text: str, place: str | None = None
) -> DataFrame:
    """Token pieces of whole texts: at most ``size`` ids each, only the first of a text may be shorter.

    ``place`` is a whole-number column that goes with them as ``_place``.
    """

    def cut(batches):
        words = vocabulary(path)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            out = ([], [], [], [], [], [])
            keys, places = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for name, ids, at in zip(keys, words.encode(batch.column(1).to_pylist()), places, strict=True):
                ids = memoryview(ids + end)
                total = len(ids) // 4
                first = total % size or size
                bounds = [0, *range(first, total + 1, size)]
                for number, (start, stop) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    row = name, number, start, stop - start, zlib.crc32(ids[start * 4 : stop * 4]), at
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()
            yield pa.record_batch(
                [pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)],
                names=[key, "piece", "start", "length", "ids_crc32", "_place"],
            )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, _place long"
    at = F.col(place).cast("long") if place else F.lit(None).cast("long")
    return docs.select(F.col(key), F.col(text), at.alias("_place")).mapInArrow(cut, schema)


def best_fit(
    lengths: np.ndarray,
    size: int,
    documents: int,
    attention: float,
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
    select: str = "norm",
) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, longest first, by vector best-fit.

    Each sequence has three residual capacities: tokens, documents and attention cost (the sum of squared
    lengths). A piece fits where all three hold. Among those, ``norm`` takes the sequence whose weighted
    residual, as shares of the capacities, is shortest once the piece is in; ``dot`` takes the largest
    weighted dot product of piece and residual. Ties go to the oldest sequence.
    """
    cap = np.array([size, documents, attention], float)
    scale = np.array(weights) / cap**2
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    sequence = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    left = np.zeros((64, 3))  # residuals of the open sequences
    names = np.zeros(64, np.int64)
    n_open = n_all = 0
    # Lengths only fall, so a sequence that cannot hold the shortest piece is closed for good.
    shortest = int(lengths.min()) if len(lengths) else 0
    for at in order:
        length = float(lengths[at])
        need = np.array([length, 1.0, length * length])
        place = -1
        if n_open:
            fits = np.flatnonzero(left[:n_open, 0] >= length)
            fits = fits[(left[fits, 1:] >= need[1:]).all(1)]
            if len(fits):
                room = left[fits]
                score = (room * need) @ -scale if select == "dot" else ((room - need) ** 2) @ scale
                place = int(fits[score.argmin()])
        if place < 0:
            if n_open == len(left):
                left, names = np.vstack([left, left]), np.concatenate([names, names])
            left[n_open], names[n_open] = cap, n_all
            place, n_open, n_all = n_open, n_open + 1, n_all + 1
        sequence[at] = names[place]
        offset[at] = size - int(left[place, 0])
        left[place] -= need
        if left[place, 0] < shortest or left[place, 1] < 1 or left[place, 2] < shortest * shortest:
            n_open -= 1
            left[place : n_open] = left[place + 1 : n_open + 1]
            names[place : n_open] = names[place + 1 : n_open + 1]
    return sequence, offset


def pack(
    docs: DataFrame,
    size: int = 1024,
    documents: int = 1024,
    attention: float = 1024.0 * 1024.0,
    end_id: int = 2,
    select: str = "norm",
    path: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    place: str | None = None,
    stretch: int = 256,
) -> DataFrame:
    """Pieces of all texts with their place in sequences of at most ``size`` tokens.

    Columns: key, piece, start, length, ids_crc32, sequence_id, offset. Each text is its ids and
    ``end_id``; a null or empty text is ``end_id`` alone. The default document and attention capacities
    are those that no sequence of ``size`` tokens can pass; set lower ones to bind. Pieces are cut so
    that none costs more than ``attention`` alone; one below 1 is an error.

    Pieces are dealt by a hash of key, piece and ids into groups of about ``ROWS_PER_GROUP`` input rows;
    each group is packed on its own, from lengths alone, so no task grows with the table and a hot
    source is spread. The price is about one half-filled sequence per group. Repeated rows are packed
    each; null keys stay null; further columns are ignored; an empty table gives no rows. Texts of any length are
    cut whole. Pieces of one length go by key, piece and ids, so the result does not depend on the order of rows.

    With ``place``, a whole-number column such as a mixture's slot, a group holds the pieces of a stretch of
    ``stretch`` places instead, so sequences in the order of their ids follow the places; a stretch should hold a
    few thousand rows. Sequences of a group are numbered by their first place.
    """
    longest = size if attention >= size * size else isqrt(int(attention))
    if longest < 1:
        raise ValueError("a piece's squared length may not pass the attention capacity")
    groups = max(1, -(-docs.count() // ROWS_PER_GROUP))
    cut = pieces(docs, longest, end_id, path, key, text, place)
    if place:
        group = F.floor(F.coalesce("_place", F.lit(0)) / stretch).cast("long")
    else:
        group = F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(groups))
    cut = cut.withColumn("_group", group)

    def fit(table: pa.Table) -> pa.Table:
        order = [("length", "descending"), *((c, "ascending") for c in (key, "piece", "ids_crc32", "_place"))]
        table = table.combine_chunks().sort_by(order).combine_chunks()
        lengths = table.column("length").to_numpy()
        sequence, offset = best_fit(lengths, size, documents, attention, select=select)
        if place:
            at = table.column("_place").fill_null(0).to_numpy()
            first = np.full(sequence.max(initial=-1) + 1, np.iinfo(np.int64).max)
            np.minimum.at(first, sequence, at)
            sequence = np.argsort(np.argsort(first, kind="stable"), kind="stable")[sequence]
        group = table.column("_group").to_numpy()
        return (
            table.drop_columns(["_group", "_place"])
            .append_column("sequence_id", pa.array(group * 2**32 + sequence))
            .append_column("offset", pa.array(offset))
        )

    schema = cut.drop("_group", "_place").schema.add("sequence_id", "long").add("offset", "long")
    return cut.groupBy("_group").applyInArrow(fit, schema)
