"""CSV files with quoted line ends, each read by many tasks.

A line end closes a record where the quotes before it, from the start of the file, are even in number: a quote
inside a quoted cell is doubled, so it counts twice. Files are read in the usual byte ranges. One light scan adds up
the quotes of each range, so that every task knows whether its range begins inside a cell; then each task puts
the lines of its range together to records. Only what is cut by a range's edge, two pieces a range at most, is
brought together across tasks. A bare quote in an unquoted cell, which no writer leaves, is not told apart.
"""

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from casework.operators.dimension import fits_in_memory
from casework.session import checkpoint

CSV = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}
#: Kinds of what a task gives: a whole record, the beginning of one that goes on in the next range, what goes on.
WHOLE, OPEN, REST = 0, 1, 2
PLACE = "_file string, _block long, _crlf boolean, _at long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [*zip(*rows, strict=True)] or [[]] * 6
    kinds = pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.string()
    names = ["_file", "_block", "_crlf", "_at", "kind", "text"]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and pieces of records from lines in the order of their ranges; blank lines are no records."""
    place, inside, begun, count, kind = None, False, [], 0, WHOLE

    def piece(of: int) -> tuple:
        return (*place, -1 if of == REST else count, of, "\n".join(begun))

    for batch in batches:
        quotes = pc.count_substring(batch.column(4), '"')
        out = []
        for file, block, crlf, start, line, n in zip(*(c.to_pylist() for c in [*batch.columns, quotes]), strict=True):
            if place is None or (file, block) != place[:2]:
                if begun:
                    out.append(piece(REST if kind == REST else OPEN))
                place, inside, begun, count = (file, block, crlf), start, [], 0
                kind = REST if inside else WHOLE
            if not inside and not line.strip():
                continue
            begun.append(line)
            inside ^= n % 2 == 1
            if not inside:
                out.append(piece(kind))
                count += kind == WHOLE
                begun, kind = [], WHOLE
        yield _batch(out)
    if begun:
        yield _batch([piece(REST if kind == REST else OPEN)])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``_file, _block, _at, text``: every record of the files, by the byte range it begins in and its place there."""
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.col("value").alias("line"), F.monotonically_increasing_id().alias("_line"),
    )
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    ranges = lines.groupBy("_file", "_block").agg(
        F.sum(quotes).alias("_quotes"), F.min_by(F.col("line").endswith("\r"), "_line").alias("_crlf")
    )
    # One row for each byte range of a file.
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    first = F.first("_crlf").over(Window.partitionBy("_file").orderBy("_block"))
    inside = F.coalesce(F.sum("_quotes").over(before), F.lit(0)) % 2 == 1
    starts = checkpoint(ranges.select("_file", "_block", first.alias("_crlf"), inside.alias("_inside")))
    keys = ["_file", "_block"]
    if fits_in_memory(starts):  # lines stay where they are
        known = lines.join(F.broadcast(starts), keys, "left")
    else:
        known = lines.join(starts, keys, "left").repartition(*keys).sortWithinPartitions(*keys, "_line")
    same = F.when(F.col("_inside").isNotNull(), F.col("_inside")).otherwise(F.raise_error(F.lit("files were cut into other ranges")).cast("boolean"))
    known = known.select("_file", "_block", "_crlf", same.alias("_inside"), "line")
    pieces = known.mapInArrow(_records, f"{PLACE}, kind int, text string")
    whole = pieces.where(F.col("kind") == WHOLE).drop("kind")
    # Records that a range's edge cuts, two pieces a range at most: those that go on belong to the last beginning.
    order = Window.partitionBy("_file").orderBy("_block", "_at")
    cut = pieces.where(F.col("kind") != WHOLE).withColumn("_record", F.sum((F.col("kind") == OPEN).cast("int")).over(order))
    parts = cut.groupBy("_file", "_record").agg(F.array_sort(F.collect_list(F.struct("_block", "_at", "_crlf", "text"))).alias("parts"))
    head = F.get("parts", F.lit(0))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    joined = parts.select("_file", *(head[c].alias(c) for c in ("_block", "_crlf", "_at")), text.alias("text"))
    # Line ends of two characters are one in cells, where the file's own are.
    text = F.regexp_replace("text", "\r$", "")
    text = F.when(F.col("_crlf"), F.replace(text, F.lit("\r\n"), F.lit("\n"))).otherwise(text)
    return whole.unionByName(joined).select("_file", "_block", "_at", text.alias("text"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The cells of CSV files with headers as texts, with ``_file, _block, _at``: where each record lies, from 0.

    Equal to Spark's reader of multi-line files, which takes one task a file. Column names are the first file's;
    the first record of every file is its header. ``_at`` counts the records of a byte range, without headers.
    """
    names = spark.read.options(**CSV).csv(path).columns
    records = csv_records(spark, path).where((F.col("_block") > 0) | (F.col("_at") > 0))
    at = F.col("_at") - F.when(F.col("_block") == 0, 1).otherwise(0)
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    cells = F.from_csv("text", schema, {"quote": '"', "escape": '"'})
    read = records.select("_file", "_block", at.alias("_at"), cells.alias("_cells"))
    return read.select(*(F.col(f"_cells.c{i}").alias(name) for i, name in enumerate(names)), "_file", "_block", "_at")
