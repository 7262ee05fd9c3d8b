"""Sinks (S7-S9). Each task writes its own file; nothing passes through the driver."""

from pyspark.sql import Column, DataFrame, functions as F

from casework import schema


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; quotes, line breaks and outer blanks of cells survive a round trip."""
    kept = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    df.write.mode(mode).options(header="true", escape='"', **kept).csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line, NULL fields kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_code_map(entries: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A code dictionary, each line an object of one code, which ``load_code_map`` reads back in as many
    tasks as there are files.

    Rows of (code, entry_text), as ``read_code_entries`` gives them, keep all fields of their entries. Rows of
    a code map, whose objects have no text, become objects of the fields they have.
    """

    def quoted(name: str) -> Column:
        whole = F.to_json(F.array(name))
        return F.substring(whole, F.lit(2), F.length(whole) - 2)

    text = F.when(F.col("entry_text").startswith("{"), F.col("entry_text")).otherwise(quoted("entry_text"))
    fields = [F.col(name) for name in schema.CODE_ENTRY.names if name in entries.columns]
    entry = F.when(F.col("entry_text").isNotNull(), text)
    entry = F.coalesce(entry, F.to_json(F.struct(*fields)) if fields else F.lit("null"))
    line = F.concat(F.lit("{"), quoted("code"), F.lit(": "), entry, F.lit("}"))
    entries.select(line.alias("value")).write.mode(mode).text(path)


def write_bucketed(
    df: DataFrame, table: str, path: str | None = None, key: str = "case_id", buckets: int = 200, mode: str = "errorifexists"
) -> None:
    """A stored layout of cases: a table in ``buckets`` files of whole ``key`` values, sorted by it.

    Decoding, records and results group and join by that key (D6c, D7, F1, F4, R7) and then move no case rows; so do
    joins with another table of as many buckets. With ``path`` the files lie there, else in the warehouse.
    """
    # Each task holds one bucket, so there is one file for each.
    writer = df.repartition(buckets, key).write.mode(mode).bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)
