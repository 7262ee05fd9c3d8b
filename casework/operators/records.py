"""Prompts, chat messages and training records."""

from pyspark.sql import Column, DataFrame, functions as F

from casework import fixed_values as fixed
from casework.functions.lists import (
    clean_differential, differential_items, differential_names, list_column, listed_names, option_text,
    parse_error,
)
from casework.functions.text import fill, strip
from casework.operators.decision import dynamic_threshold
from casework.operators.decoding import MAX_ROWS, listed_texts, sex_text, symptom_lines
from casework.operators.dimension import join_rows


def prepare_cases(df: DataFrame, code_map: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Parse each list cell once and decode the symptoms: the columns that prompts and results use.

    The evidences are read on one side of a join by ``case_id`` and the rest on the other.

    An unreadable evidence list counts as empty and is told in ``evidence_error``. An unreadable
    differential leaves the truth as the only option with threshold 1.
    """
    listed = df.select(
        "case_id", "EVIDENCES", list_column(df, "EVIDENCES", "literal").alias("codes")
    ).withColumns(
        {
            "num_evidences": F.coalesce(F.size("codes"), F.lit(0)),
            "evidence_error": parse_error(F.col("codes"), F.col("EVIDENCES")),
        }
    )
    told = ["num_evidences", "evidence_error"]
    lines = symptom_lines(listed, code_map, carried=told, max_rows=max_rows)
    items = differential_items(F.col("DIFFERENTIAL_DIAGNOSIS"), "literal")
    parsed = df.withColumn("_items", items)
    parsed = parsed.withColumn("options", differential_names(F.col("_items"), F.col("PATHOLOGY")))
    count = F.size("options")
    parsed = parsed.withColumns(
        {
            "sex_text": sex_text(F.col("SEX")),
            "diagnosis_options": option_text(F.col("options")),
            "num_diagnosis_options": count,
            "confidence_threshold": F.when(F.col("_items").isNull(), F.lit(1.0)).otherwise(
                dynamic_threshold(count)
            ),
        }
    ).drop("_items")
    return join_rows(parsed, lines, "case_id")


def _case_fields() -> dict[str, Column]:
    return {
        "age": F.col("AGE"),
        "sex": F.col("sex_text"),
        "symptoms": F.col("symptoms"),
        "num_evidences": F.col("num_evidences"),
        "options": F.col("diagnosis_options"),
    }


def user_prompt(prepared: DataFrame) -> DataFrame:
    """the case prompt."""
    return prepared.withColumn("user_prompt", fill(fixed.CASE_PROMPT, **_case_fields()))


def user_prompt_rules(prepared: DataFrame, severe_text: Column) -> DataFrame:
    """the case prompt with threshold and severe list. ``severe_text`` is a literal or the scalar of
    ``severe_block``."""
    return prepared.withColumn("severe_disease_list", severe_text).withColumn(
        "user_prompt",
        fill(
            fixed.CASE_PROMPT_WITH_RULES,
            threshold=F.col("confidence_threshold"),
            severe=F.col("severe_disease_list"),
            **_case_fields(),
        ),
    )


def system_prompt() -> Column:
    """the fixed rules and output form."""
    return F.lit(fixed.SYSTEM_PROMPT)


def to_messages(df: DataFrame, roles: dict[str, Column], out: str = "messages") -> DataFrame:
    """chat messages from the given role -> text, in order, next to all other columns."""
    parts = [
        F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in roles.items()
    ]
    return df.withColumn(out, F.array(*parts))


def conversation_messages(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", size: int = 1000
) -> DataFrame:
    """F6 of conversations with several turns: ``key, part, messages`` in the order of their turns.

    A part holds the turns of one stretch of ``size`` numbers, so that a conversation of any length is no one row;
    one of up to ``size`` turns is one part. Equal turns go by role and text. Rows without a key or turn are no messages.
    """
    at = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))
    parts = turns.where(F.col(key).isNotNull() & F.col(turn).isNotNull())
    parts = parts.groupBy(key, F.floor(F.col(turn) / size).alias("part")).agg(F.array_sort(F.collect_list(at)).alias("_m"))
    message = lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))
    return parts.select(key, "part", F.transform("_m", message).alias("messages"))


def _first(items: Column, n: int | None) -> Column:
    """The first ``n`` items, or all."""
    return items if n is None else F.slice(items, 1, n)


def training_record_a(
    df: DataFrame,
    code_map: DataFrame,
    max_rows: int = MAX_ROWS,
    decoded_codes: int | None = 15,
    named: int | None = 10,
    diagnoses: int | None = 3,
) -> DataFrame:
    """question records. ``decoded_codes`` codes are decoded, ``named`` of them are named and the rest of
    them counted; ``diagnoses`` of the differential are named. None is all: with ``decoded_codes`` None the
    rest is counted on the whole list."""
    listed = df.select("case_id", list_column(df, "EVIDENCES", "json").alias("_codes"))
    texts = listed_texts(listed, code_map, "_codes", decoded_codes, "_texts", max_rows=max_rows)
    items = differential_items(F.col("DIFFERENTIAL_DIAGNOSIS"), "json")
    decoded = join_rows(df.withColumn("_items", items), texts, "case_id")
    more = F.size("_texts") - (named if named is not None else F.size("_texts"))
    symptoms = F.concat(
        F.array_join(_first(F.col("_texts"), named), ", "),
        F.when(more > 0, fill(fixed.QUESTION_RECORD_MORE, more=more)).otherwise(F.lit("")),
    )
    names = listed_names(_first(F.col("_items"), diagnoses))
    differential = F.when(
        F.size("_items") > 0,
        fill(fixed.QUESTION_RECORD_DIFFERENTIAL, names=F.array_join(names, ", ")),
    ).otherwise(F.lit(""))
    return decoded.select(
        "case_id",
        fill(fixed.QUESTION_RECORD, age=F.col("AGE"), sex=F.col("SEX"), symptoms=symptoms).alias(
            "instruction"
        ),
        F.lit("").alias("input"),
        F.concat("PATHOLOGY", differential).alias("output"),
        F.struct(
            F.col("AGE").alias("age"), F.col("SEX").alias("sex"), F.col("PATHOLOGY").alias("pathology")
        ).alias("metadata"),
    )


def training_record_b(df: DataFrame, evidences: int | None = 20, diagnoses: int | None = 8) -> DataFrame:
    """label records with raw codes, the first ``evidences`` and ``diagnoses`` (None: all); no join and no
    shuffle."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(fixed.UNKNOWN))

    return df.select(
        "case_id",
        F.lit(fixed.LABEL_RECORD_INSTRUCTION).alias("instruction"),
        fill(
            fixed.LABEL_RECORD_INPUT,
            age=text("AGE"),
            sex=text("SEX"),
            initial=text("INITIAL_EVIDENCE"),
            evidences=F.array_join(_first(list_column(df, "EVIDENCES", "safe"), evidences), ", "),
            differential=F.array_join(
                _first(clean_differential(F.col("DIFFERENTIAL_DIAGNOSIS")), diagnoses), ", "
            ),
        ).alias("input"),
        strip(F.coalesce("PATHOLOGY", F.lit(""))).alias("output"),
    )
