"""Exact removal of repeated passages: all bytes covered by a string that occurs more than once.

Every string of ``length`` bytes has an anchor, the k-gram in it with the least hash; equal strings have equal
anchors at equal places. Neighbouring strings with one anchor make a segment. Segments whose anchor occurs
once hold nothing repeated. Equal segments repeat as wholes. What differs but shares an anchor is aligned at
it and goes through the column-wise construction, whose common prefixes tell which strings repeat.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from casework.llm.collection_bwt import repeated_starts
from casework.llm.names import free
from casework.session import written

#: Bytes of an anchor, and positions that are worked on at once.
ANCHOR, STRETCH = 32, 1 << 20
#: Segments of one anchor from which it is parted by the bytes around it, and starts of such a part.
HOT, PART = 4_096, 16
#: Segments that one construction takes, about.
AT_ONCE = 8_192


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from each position, doubling the span of the hash."""
    h = _BYTES[data]
    span = 1
    while span < ANCHOR:
        h = h[: len(h) - span] * np.uint64(0xBF58476D1CE4E5B9 + 2 * span) + h[span:]
        span *= 2
    return _mixed(h)


def segments(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First string, number of strings, place and hash of the anchor of each segment of a text."""
    window = length - ANCHOR + 1
    data = np.frombuffer(text, np.uint8)
    strings = len(data) - length + 1
    out = []
    for at in range(0, strings, STRETCH):
        n = min(STRETCH, strings - at)
        h = gram_hashes(data[at : at + n + length - 1])
        # The hash's high bits, then the place: the least is the leftmost least. Minima of a sliding window
        # are those of the end of one stretch of its width and of the start of the next.
        low = np.uint64((1 << 21) - 1)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        padded = np.full(-(-len(key) // window) * window, np.iinfo(np.uint64).max)
        padded[: len(key)] = key
        parts = padded.reshape(-1, window)
        before = np.minimum.accumulate(parts, axis=1).ravel()
        after = np.minimum.accumulate(parts[:, ::-1], axis=1)[:, ::-1].ravel()
        owner = (np.minimum(after[:n], before[window - 1 : window - 1 + n]) & low).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
        count = np.diff(np.concatenate([first, [n]]))
        out.append((first + at, count, owner[first] + at, h[owner[first]].view(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _text_id(text: str) -> list[Column]:
    """80 bits that tell a text: equal texts share their result, so rows need no key."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(whole).alias("text_id"), F.xxhash64(whole, F.lit("tag")).bitwiseAND(0xFFFF).alias("tag")]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _segment_rows(length: int):
    """Rows of segments: anchor, segment, text_id, and place (first string, strings, anchor, tag)."""

    def run(batches):
        for batch in batches:
            out = []
            for text, name, tag in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(text) < length:
                    continue
                first, count, place, anchor = segments(text, length)
                ends = first + count + length - 1
                spans = zip(first.tolist(), ends.tolist(), strict=True)
                own = np.fromiter((xxh3_64_intdigest(text[i:j]) for i, j in spans), np.uint64, len(first))
                packed = first << 32 | count << 24 | (place - first) << 16 | tag
                out.append((anchor, own.view(np.int64), np.full(len(first), name), packed))
            columns = [np.concatenate(x) for x in zip(*out, strict=True)] or [np.zeros(0, np.int64)] * 4
            yield pa.record_batch([pa.array(c) for c in columns], names=["anchor", "segment", "text_id", "place"])

    return run


def _cut(length: int):
    """Segments cut out of texts, those of hot anchors parted by the bytes that a part's strings share."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(8)]

            def put(*row, out=out):
                for column, value in zip(out, row, strict=True):
                    column.append(value)

            for text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for s in wanted:
                    first, count, at = s["place"] >> 32, s["place"] >> 24 & 0xFF, s["place"] >> 16 & 0xFF
                    bytes_ = text[first : first + count + length - 1]
                    if not s["hot"]:
                        put(s["anchor"], s["anchor"], s["segment"], 0, bytes_, at, count, s["twin"])
                        continue
                    # Part c holds the strings that start PART * c to PART * c + PART - 1 before the anchor.
                    for c in range((at - count + 1) // PART, at // PART + 1):
                        start = max(0, at - PART * c - PART + 1)
                        stop = min(count, at - PART * c + 1)
                        anchor = first + at
                        shared = text[anchor - PART * c : anchor - PART * c - PART + 1 + length]
                        group = _signed(xxh3_64_intdigest(shared, c + 1))
                        part = bytes_[start : stop + length - 1]
                        put(group, s["anchor"], s["segment"], start, part, at - start, stop - start, s["twin"])
            kinds = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 2 + [pa.bool_()]
            names = ["group", "anchor", "segment", "start", "bytes", "at", "strings", "twin"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return run


def _construct(length: int):
    """Repeated strings of segments that come sorted by group, segment and start."""

    def solve(rows):
        group = np.array([r[0] for r in rows])
        _, group = np.unique(group, return_inverse=True)  # rows are sorted, so groups are
        texts, at, strings = [r[4] for r in rows], np.array([r[5] for r in rows]), np.array([r[6] for r in rows])
        found = repeated_starts(texts, at, strings, group, length)
        out = []
        for row, marks in zip(rows, found, strict=True):
            if row[7] or not marks.any():
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
            out.append((row[1], row[2], [int(a + row[3]) << 16 | int(b + row[3]) for a, b in edges.reshape(-1, 2)]))
        columns = [*zip(*out, strict=True)] or [[], [], []]
        kinds = pa.int64(), pa.int64(), pa.list_(pa.int64())
        return pa.record_batch(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["anchor", "segment", "ranges"]
        )

    def run(batches):
        held, group = [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[0] != group[0][0]:
                    if len(group) > 1:
                        held += group
                    group = []
                    if len(held) >= AT_ONCE:
                        yield solve(held)
                        held = []
                # Equal texts give the same segment again.
                if not group or row[1:4] != group[-1][1:4]:
                    group.append(row)
        if len(group) > 1:
            held += group
        if held:
            yield solve(held)

    return run


def repeated_spans(docs: DataFrame, length: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``spans``: the byte ranges covered by repeated strings, in order.

    A string of ``length`` bytes (64 to 250) repeats if it starts anywhere else, in the same text too; matches
    never cross texts, overlapping ones count, and all are judged on the input. Ranges are [start, end) in
    UTF-8 bytes, apart from each other; texts without any, null and short ones have an empty array. Rows
    that repeat are occurrences of their own; keys may be null or repeat; a column named ``spans`` is
    replaced; an empty table gives no rows.

    What moves: two short rows per segment (about every 85 bytes), those of repeated anchors once more, one
    copy of each segment that shares an anchor but not all bytes, and the texts twice. An anchor with over
    HOT segments, such as a very common line, is parted by the bytes around it.
    """
    if not 2 * ANCHOR <= length <= 250:
        raise ValueError("length has to be 64 to 250")
    docs = docs.drop("spans")
    ids = _text_id(text)
    bytes_ = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(bytes_.alias("bytes"), *ids)
    segs = rows.mapInArrow(_segment_rows(length), "anchor long, segment long, text_id long, place long")
    often = segs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    # Written, so that the join is one of two shuffles, of which a hot anchor's part can be split.
    often, _ = written(often, "anchors")
    shared, _ = written(segs.join(often, "anchor"), "segments")

    distinct = shared.groupBy("anchor", "segment").agg(
        F.count("*").alias("n"), F.min(F.struct("text_id", "place")).alias("one")
    )
    distinct, _ = written(distinct, "distinct")
    kinds = distinct.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    unlike = distinct.join(kinds, "anchor").select(
        "one.text_id", (F.col("one.place").bitwiseAND(0xFFFF)).alias("tag"),
        F.struct(
            "anchor", "segment", "one.place", (F.col("n") > 1).alias("twin"), (F.col("kinds") > HOT).alias("hot")
        ).alias("s"),
    )
    wanted = unlike.groupBy("text_id", "tag").agg(F.collect_list("s").alias("wanted"))
    # One row of each text gives its segments.
    first = docs.select(*ids, F.col(key).alias("key")).groupBy("text_id", "tag").agg(F.min("key").alias("key"))
    wanted = wanted.join(first, ["text_id", "tag"])
    texts = docs.select(bytes_.alias("bytes"), *ids, F.col(key).alias("key")).alias("t")
    same = " and ".join(f"t.{c} = w.{c}" for c in ("text_id", "tag")) + " and t.key <=> w.key"
    cut = texts.join(wanted.alias("w"), F.expr(same)).select("bytes", "wanted").mapInArrow(
        _cut(length),
        "group long, anchor long, segment long, start long, bytes binary, at long, strings long, twin boolean",
    )
    found = cut.repartition("group").sortWithinPartitions("group", "anchor", "segment", "start")
    found = found.mapInArrow(_construct(length), "anchor long, segment long, ranges array<long>")
    twins = distinct.where("n > 1").select("anchor", "segment", F.lit(None).cast("array<long>").alias("ranges"))
    verdict = twins.unionAll(found)

    place = F.col("place")
    first_, count = F.shiftright(place, 32), F.shiftright(place, 24).bitwiseAND(0xFF)
    ranges = F.coalesce("ranges", F.array(count))  # strings 0 to count
    covered = shared.join(verdict, ["anchor", "segment"]).select(
        "text_id", place.bitwiseAND(0xFFFF).alias("tag"), first_.alias("first"), F.explode(ranges).alias("r")
    )
    start = F.col("first") + F.shiftright("r", 16)
    end = F.col("first") + F.col("r").bitwiseAND(0xFFFF) + (length - 1)
    covered = covered.select("text_id", "tag", start.alias("start"), end.alias("end")).distinct()
    # Ranges that touch or overlap become one: one begins where no earlier one of its text reaches.
    own = "over (partition by text_id, tag order by start, end"
    reach = F.expr(f"max(end) {own} rows between unbounded preceding and 1 preceding)")
    begun = covered.withColumn("_new", F.when(F.col("start") <= reach, 0).otherwise(1))
    begun = begun.withColumn("_run", F.expr(f"sum(_new) {own} rows between unbounded preceding and current row)"))
    runs = begun.groupBy("text_id", "tag", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = runs.groupBy("text_id", "tag").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    own = free(docs, "text_id", "tag", "found")
    none = F.array().cast(spans.schema["spans"].dataType)
    all_ = docs.select("*", ids[0].alias(own[0]), ids[1].alias(own[1]))
    return all_.join(spans.toDF(*own), own[:2], "left").select(*docs.columns, F.coalesce(own[2], none).alias("spans"))


def kept_bytes(text: str | None, spans: list[dict]) -> bytes:
    """The bytes of a text outside of ``spans``."""
    data, at, out = (text or "").encode(), 0, []
    for span in spans:
        out.append(data[at : span["start"]])
        at = span["end"]
    return b"".join([*out, data[at:]])


def digests(found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256`` of what ``repeated_spans`` returns."""

    def run(batches):
        for batch in batches:
            out = []
            for name, whole, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size = sum(s["end"] - s["start"] for s in spans)
                kept = kept_bytes(whole, spans)
                out.append((name, len(kept) + size, size, len(spans), hashlib.sha256(kept).hexdigest()))
            names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            kinds = batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string()
            columns = [*zip(*out, strict=True)] or [[]] * 5
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    kind = found.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return found.select(key, text, "spans").mapInArrow(run, schema)


def without_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """What ``repeated_spans`` returns, its spans taken out of the text; null texts stay null.

    Spans lie between bytes; a character that is covered in part only stays.
    """
    at, spans = found.columns.index(text), found.columns.index("spans")

    def inside(data: bytes, span: dict) -> dict:
        start, end = span["start"], span["end"]
        while start < len(data) and data[start] & 0xC0 == 0x80:
            start += 1
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        return {"start": start, "end": max(start, end)}

    def run(batches):
        for batch in batches:
            out = []
            for whole, found_ in zip(batch.column(at).to_pylist(), batch.column(spans).to_pylist(), strict=True):
                if whole is not None and found_:
                    data = whole.encode()
                    whole = kept_bytes(whole, [inside(data, s) for s in found_]).decode()
                out.append(whole)
            columns = [pa.array(out, pa.string()) if i == at else c for i, c in enumerate(batch.columns) if i != spans]
            yield pa.record_batch(columns, names=[n for n in batch.schema.names if n != "spans"])

    return found.mapInArrow(run, found.drop("spans").schema)
