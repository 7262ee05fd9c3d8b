"""Loaders (S1-S6). Types are declared, nothing is inferred, and casts happen once here."""

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from casework import fixed_values as fixed, schema
from casework.functions.json_text import STRICT
from casework.functions.text import is_blank, strip
from casework.sources.split_csv import read_csv


def _require(found: list[str], wanted: list[str], path: str) -> None:
    missing = [name for name in wanted if name not in found]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")


def _by_name(spark: SparkSession, path: str, form: str, declared, optional: tuple = ()) -> DataFrame:
    """The declared columns of a table by their names, whatever their order; others are left out."""
    if form == "json":  # read by name already; nested types cannot be told from the rows
        return spark.read.schema(declared).json(path)
    df = read_csv(spark, path) if form == "csv" else spark.read.format(form).load(path)
    _require(df.columns, [f.name for f in declared if f.name not in optional], path)
    columns = []
    for field in declared:
        if field.name in df.columns:
            cell = F.col(f"`{field.name}`")
            if form == "csv" and field.dataType.simpleString() != "string":
                cell = strip(cell).try_cast(field.dataType)
            columns.append(cell.cast(field.dataType).alias(field.name))
    if form == "parquet":
        columns += [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    if form == "csv":
        columns += ["_file", "_block", F.col("_at").alias("_row")]
    return df.select(*columns)


def _numbered(df: DataFrame, key: str) -> DataFrame:
    """Rows numbered from 0 in the order of files and of rows in them, where ``key`` is not given.

    Only the number of rows before each file, byte range of a CSV file, or read piece of other forms is added up:
    one row for each.
    """
    if "_file" not in df.columns:
        place = F.monotonically_increasing_id()
        df = df.withColumn("_row", place).withColumn("_file", F.shiftright("_row", 33).cast("string"))
        df = df.withColumn("_row", F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)))
        df = df.withColumn("_file", F.lpad("_file", 12, "0"))
    parts = ["_file", "_block"] if "_block" in df.columns else ["_file"]
    sizes = df.groupBy(*parts).agg((F.max("_row") + 1).alias("_size"))
    before = Window.orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*parts, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return df.join(starts, parts).withColumn(key, F.col("_before") + F.col("_row")).drop("_before")


def load_cases(
    spark: SparkSession, paths: dict[str, str], form: str = "parquet", declared=schema.CASES, key: str = "case_id"
) -> DataFrame:
    """One table per split, read into one DataFrame with a ``split`` column.

    Columns go by their names; a missing one is an error. Where the files hold no ``key``, it is the row's
    position in its split, from 0.
    """
    names = [field.name for field in declared]
    parts = []
    for split, path in paths.items():
        part = _by_name(spark, path, form, declared, (key,))
        if key not in part.columns and key in names:
            part = _numbered(part, key)
        parts.append(part.select(*[n for n in names if n in part.columns], F.lit(split).alias("split")))
    return reduce(DataFrame.unionByName, parts)


def code_entries(entries: DataFrame) -> DataFrame:
    """S2 on rows of (code, entry_text): the fields of each entry.

    Entries that are no objects keep their text in ``entry_text`` only.
    """
    is_object = F.col("entry_text").startswith("{")
    entry = F.when(is_object, F.from_json("entry_text", schema.CODE_ENTRY, STRICT))
    return entries.withColumn("entry", entry).select(
        "code",
        "entry.name",
        "entry.question_en",
        "entry.data_type",
        "entry.value_meaning",
        F.when(~is_object, F.col("entry_text")).alias("entry_text"),
    )


def read_code_entries(spark: SparkSession, path: str) -> DataFrame:
    """JSON objects of code -> entry as rows of (code, entry_text), all fields kept.

    A folder holds lines of one object each, as ``write_code_map`` leaves them, read in many tasks; a file
    is one object, read by one task.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
    objects = spark.read.text(path, wholetext=not folder)
    return objects.select(F.explode(F.from_json("value", "map<string,string>", STRICT)).alias("code", "entry_text"))


def load_code_map(spark: SparkSession, path: str) -> DataFrame:
    """Code -> entry objects as one row per code."""
    return code_entries(read_code_entries(spark, path))


def load_qa(
    spark: SparkSession, paths: dict[str, str], form: str = "parquet", declared=schema.QA, key: str = "qa_id"
) -> DataFrame:
    """S3: multiple-choice questions with an option map, per split; ids and names as for the cases."""
    return load_cases(spark, paths, form, declared, key)


def catalog_rows(categories: DataFrame) -> DataFrame:
    """S4 on rows of (category, paths): (category, pos, path)."""
    return categories.select("category", F.posexplode("paths").alias("pos", "path"))


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A JSON catalog ``{"categories": {name: [path, ...]}}`` as (category, pos, path).

    One JSON object is read by one task; it holds names only, no texts.
    """
    whole = spark.read.text(path, wholetext=True)
    catalog = F.from_json("value", "categories map<string,array<string>>")
    return catalog_rows(whole.select(F.explode(catalog["categories"]).alias("category", "paths")))


def corpus_path(path: str, root: str) -> F.Column:
    """A file's path below the folder ``root``, which is an absolute path without a scheme."""
    plain = F.regexp_replace(F.col(path), "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.substring(plain, F.lit(len(root.rstrip("/")) + 2), F.length(plain))


def split_corpus(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S5 on rows of (path, content): documents and failures. Blank files are in neither."""
    readable = F.coalesce(F.is_valid_utf8(F.col("content")), F.lit(False))
    parts = F.split("path", "/")
    docs = (
        files.where(readable)
        .select(
            "path",
            F.coalesce(F.get(parts, F.lit(1)), F.lit("unknown")).alias("category"),
            F.element_at(parts, -1).alias("filename"),
            F.col("content").cast("string").alias("text"),
        )
        .where(~is_blank(F.col("text")))
    )
    failures = files.where(~readable).select("path", F.lit("text is not valid UTF-8").alias("error"))
    return docs, failures


def load_corpus(
    spark: SparkSession, root: str, pattern: str = "*", listed: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """The text files below the folder ``root`` as (path, category, filename, text) and (path, error).

    With ``listed``, rows of (path) below the root such as a catalog's, only those files are read, and
    the ones that are not there are failures. The driver then holds their names, as it does when it lists them.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = system.makeQualified(hadoop).toUri().getPath()
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    files = reader.load(root).withColumn("file", F.col("path")).withColumn("path", corpus_path("file", base))
    if listed is None:
        return split_corpus(files.select("path", "content"))
    wanted = listed.select("path").distinct()
    there = files.select("path", "file")
    chosen = [row["file"] for row in there.join(wanted, "path", "left_semi").select("file").collect()]
    gone = wanted.join(there, "path", "left_anti").select("path", F.lit("no such file").alias("error"))
    if not chosen:
        docs, failures = split_corpus(files.where("false").select("path", "content"))
    else:
        escaped = [re.sub(r"([\\{}\[\]*?])", r"\\\1", name) for name in chosen]  # globs are on
        some = reader.load(escaped).withColumn("path", corpus_path("path", base))
        docs, failures = split_corpus(some.select("path", "content"))
    return docs, failures.unionByName(gone)


def read_results(spark: SparkSession, path: str, declared=schema.RESULTS) -> DataFrame:
    """A results CSV with quoted multi-line cells, columns by header name; the usual tokens for "missing"
    become NULL. A missing column is an error. A file is read by many tasks (``split_csv``)."""
    text = read_csv(spark, path)
    _require(text.columns, [field.name for field in declared], path)
    columns = []
    for field in declared:
        cell = F.col(f"`{field.name}`")
        cell = F.when(~cell.isin(list(fixed.MISSING_CELLS)), cell)
        if field.dataType.simpleString() != "string":
            cell = strip(cell).try_cast(field.dataType)
        columns.append(cell.alias(field.name))
    return text.select(*columns)
