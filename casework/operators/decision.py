"""The decision layer (L1-L5): count options, set the threshold, accept or refer."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casework import fixed_values as fixed
from casework.functions.text import WS, line_count, strip
from casework.operators.dimension import MAX_ROWS, join_dimension

SEVERE_DEFAULT = fixed.SEVERE_DEFAULT
Severe = DataFrame | Sequence[str]


def severe_table(spark: SparkSession, names: Sequence[str] = SEVERE_DEFAULT) -> DataFrame:
    """The severe set as a dimension."""
    return spark.createDataFrame([(name,) for name in names], "disease string")


def count_options(c: Column) -> Column:
    """L1: lines that are not blank; NULL counts 0."""
    return F.coalesce(line_count(c), F.lit(0))


def option_names(c: Column) -> Column:
    """The text after the first dot of each line that is not blank."""
    lines = F.filter(F.split(strip(c), "\n"), lambda line: line.rlike(f"[^{WS}]"))
    return F.transform(lines, lambda line: strip(F.regexp_replace(line, r"^[^.]*\.", "")))


def dynamic_threshold(n: Column) -> Column:
    """L2: two in ``n``, and 1 without options."""
    return F.when(n > 0, F.lit(2.0) / n).otherwise(F.lit(1.0))


def mark_severe(
    df: DataFrame, column: str, severe: Severe = SEVERE_DEFAULT, out: str = "is_severe",
    key: str = "case_id", max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Whether ``column`` is in the severe set. A list of names is a literal set; a table is joined."""
    if not isinstance(severe, DataFrame):
        return df.withColumn(out, F.coalesce(F.col(column).isin(list(severe)), F.lit(False)))
    marks = severe.select(F.col("disease").alias(column)).distinct().withColumn("_severe", F.lit(True))
    joined = join_dimension(df, marks, column, key, max_rows)
    return joined.select(*df.columns, F.coalesce("_severe", F.lit(False)).alias(out))


def _refers_low(confidence: Column, threshold: Column, missing: str) -> Column:
    if missing not in ("pass", "refer"):
        raise ValueError(f"unknown treatment of missing confidence {missing!r}")
    return F.coalesce(confidence < threshold, F.lit(missing == "refer"))


def decide(df: DataFrame, severe: Severe = SEVERE_DEFAULT, missing: str = "pass", **join) -> DataFrame:
    """L3: refer a severe disease or a confidence below the threshold, else keep the disease.

    Reads ``predicted_rank1_disease``, ``predicted_rank1_confidence`` and ``threshold``; writes
    ``rank1_disease`` and ``rank1_confidence``. A missing confidence is not low by default.
    """
    marked = mark_severe(df, "predicted_rank1_disease", severe, "_is_severe", **join)
    low = _refers_low(F.col("predicted_rank1_confidence"), F.col("threshold"), missing)
    return marked.withColumns(
        {
            "rank1_disease": F.when(F.col("_is_severe") | low, F.lit(fixed.REFER)).otherwise(
                F.col("predicted_rank1_disease")
            ),
            "rank1_confidence": F.col("predicted_rank1_confidence"),
        }
    ).drop("_is_severe")


def refer_reason(is_severe: Column, missing: str = "pass") -> Column:
    """L4: why a row of ``predicted_rank1_confidence`` and ``threshold`` is referred, severity first, or ``none``."""
    low = _refers_low(F.col("predicted_rank1_confidence"), F.col("threshold"), missing)
    return F.when(is_severe, F.lit("severity")).when(low, F.lit("low_confidence")).otherwise(F.lit("none"))


def decide_with_reason(
    df: DataFrame, severe: Severe = SEVERE_DEFAULT, missing: str = "pass", **join
) -> DataFrame:
    """L4: as ``decide``, with ``is_severe``, ``decision`` and ``refer_reason`` (severity first)."""
    marked = mark_severe(df, "predicted_rank1_disease", severe, **join)
    reason = refer_reason(F.col("is_severe"), missing)
    return marked.withColumn("refer_reason", reason).withColumn(
        "decision",
        F.when(F.col("refer_reason") == "none", F.col("predicted_rank1_disease")).otherwise(
            F.lit(fixed.REFER)
        ),
    )


def to_scoring(
    decided: DataFrame, correct: Column, severe_of: str = "predicted", severe: Severe = SEVERE_DEFAULT,
    truth: str = "true_diagnosis", **join,
) -> DataFrame:
    """A decided run in the columns that scoring reads.

    ``correct`` tells whether the disease before the decision was right. Severity is that of the
    predicted disease, or of the true one with ``severe_of='true'``.
    """
    if severe_of == "true":
        decided = mark_severe(decided.drop("is_severe"), truth, severe, **join)
    elif severe_of != "predicted":
        raise ValueError(f"unknown severity source {severe_of!r}")
    return decided.select("case_id", *scoring_columns(correct, F.col("is_severe"), F.col("refer_reason")))


def scoring_columns(correct: Column, is_severe: Column, reason: Column) -> list[Column]:
    """What scoring reads of a row, besides its id."""
    refer = reason != "none"
    confidence = F.col("predicted_rank1_confidence")
    return [
        F.coalesce(correct, F.lit(False)).alias("correct"),
        confidence.alias("confidence"),
        F.col("number_of_options").alias("num_options"),
        F.when(refer, F.lit("REFER")).otherwise(F.lit("DIAGNOSE")).alias("action"),
        is_severe.alias("is_severe"),
        F.coalesce(confidence > F.col("threshold"), F.lit(False)).alias("high_confidence"),
        F.when(refer, reason).alias("refer_reason"),
    ]
