"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through the Gray-order index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from casework.llm.components import components
from casework.llm.gray_index import hamming_links
from casework.llm.names import free
from casework.session import written

SEED = 42
#: Shingles whose bits are added up at once.
BLOCK = 1 << 16


def _shingles(text: str | None, words: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a text, joined by blanks, and where its shingles start and end in that."""
    found = (text or "").encode().lower().split()
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found], dtype=np.int64) - 1
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])[: len(found)]
    if len(found) < words:
        return joined, starts[:1], ends[-1:]
    return joined, starts[: len(found) - words + 1], ends[words - 1 :]


def fingerprint(text: str | None, words: int) -> int:
    """The fingerprint of one text: a bit is 1 if over half of its shingles' hashes set it.

    A-Z are lower-cased; words are parted by blanks and control characters 9 to 13; a text of fewer words
    than a shingle has is one shingle; a text without words (or null) has fingerprint 0.
    """
    joined, first, last = _shingles(text, words)
    if not len(first):
        return 0
    total = np.zeros(64, np.int64)
    for at in range(0, len(first), BLOCK):
        spans = zip(first[at : at + BLOCK].tolist(), last[at : at + BLOCK].tolist(), strict=True)
        hashes = np.array([xxh64_intdigest(joined[i:j], SEED) for i, j in spans], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, code long, digest long`` (of the text itself) of every whole text; no row moves."""

    def run(batches):
        for batch in batches:
            codes = [fingerprint(x, words) for x in batch.column(1).to_pylist()]
            codes = pa.array(np.array(codes, np.uint64).view(np.int64))
            yield pa.record_batch([batch.column(0), codes, batch.column(2)], names=["key", "code", "digest"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("digest"))
    return rows.mapInArrow(run, "key long, code long, digest long")


def _grouped(docs: DataFrame, words: int, distance: int, key: str, text: str) -> DataFrame:
    """``fingerprints`` with the ``component_id`` of each row."""
    prints, _ = written(fingerprints(docs, words, key, text), "prints")
    # A print is a node under its own name, whatever keys have it: a key with two texts links nothing.
    nodes = prints.where("key is not null").groupBy("code").agg(F.min("key").alias("least"))
    nodes, _ = written(nodes.select("code", F.col("code").alias("node"), "least"), "codes")
    found = components(hamming_links(nodes, distance))
    linked, _ = written(nodes.join(found, "node").select("code", "component", "least"), "linked")
    # Prints without a link, the usual case, stand for themselves and need no grouping.
    names = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = linked.join(names, "component").select("code", "component_id")
    alone = nodes.join(linked, "code", "left_anti").select("code", F.col("least").alias("component_id"))
    # One row for each code: a code with a third of all rows is a skewed join, which Spark splits.
    return prints.join(named.unionAll(alone), "code", "left")


def near_duplicates(
    docs: DataFrame, words: int = 5, distance: int = 3, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key, fingerprint, component_id``: documents whose fingerprints differ in at most ``distance`` bits.

    Links are transitive; ``component_id`` is the smallest key that links reach. Equal fingerprints are one
    node from the start, so copies cost one grouping whatever their number. ``key`` is an integer; rows
    with a null key get a fingerprint and a component of their fingerprint's links, null if no keyed row
    has it. Null and empty texts have fingerprint 0 and link like any other. Rows that repeat stay, and texts that
    share a key link only by their fingerprints; further columns are ignored; an empty table gives no rows.
    """
    fingerprint_ = F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint")
    return _grouped(docs, words, distance, key, text).select(F.col("key").alias(key), fingerprint_, "component_id")


def without_near_duplicates(
    docs: DataFrame, words: int = 5, distance: int = 3, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs``, one of each group of ``near_duplicates``: that with the smallest key.

    Where a key repeats with other texts of its group, that with the smallest fingerprint stays; of rows equal in key
    and text, one. Texts that share a key with a removed one stay if their own group has them first. Rows without a
    key are all kept; all columns stay, whatever their names; an empty table gives no rows.
    """
    rows = _grouped(docs, words, distance, key, text).where("key is not null")
    rows, _ = written(rows.groupBy("component_id", "key", "code", "digest").agg(F.count("*").alias("n")), "groups")
    first = rows.groupBy("component_id").agg(F.min(F.struct("key", "code", "digest")).alias("first"))
    first = first.select("first.*")
    gone = rows.select("key", "digest").distinct().join(first, ["key", "digest"], "left_anti")
    own = free(docs, "kept_key", "kept_digest")
    marked = docs.withColumns({own[0]: F.col(key).cast("long"), own[1]: F.xxhash64(text)})
    kept = marked.join(gone.toDF(*own), own, "left_anti")
    if not rows.where("n > 1").join(first, ["key", "code", "digest"], "left_semi").isEmpty():
        keyed = kept.where(F.col(own[0]).isNotNull()).dropDuplicates(own)
        kept = keyed.unionAll(kept.where(F.col(own[0]).isNull()))
    return kept.select(*docs.columns)
