"""Code decoding."""

from pyspark.sql import Column, DataFrame, functions as F

from casework import fixed_values as fixed
from casework.functions.text import strip
from casework.operators.dimension import MAX_ROWS, join_dimension, join_rows


def _other_entry(code_map: DataFrame) -> Column:
    if "entry_text" in code_map.columns:
        return F.col("entry_text")
    return F.lit(None).cast("string")


def code_texts(code_map: DataFrame, variant: str) -> DataFrame:
    """(code, text): ``name`` prefers the entry's name, ``question`` its question, then its name."""
    if variant == "name":
        text = F.coalesce(_other_entry(code_map), "name", "code")
    elif variant == "question":
        text = F.coalesce("question_en", "name", "code")
    else:
        raise ValueError(f"unknown variant {variant!r}")
    return code_map.select("code", text.alias("_text"))


def _decode_one(df, code_map, column, out, key, variant, max_rows):
    texts = code_texts(code_map, variant).withColumnRenamed("code", column)
    joined = join_dimension(df, texts, column, key, max_rows)
    return joined.withColumn(out, F.coalesce("_text", column)).select(*df.columns, out)


def decode_name(
    df: DataFrame, code_map: DataFrame, column: str, out: str, key: str = "case_id",
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """A code column to its name, else the code itself."""
    return _decode_one(df, code_map, column, out, key, "name", max_rows)


def decode_question(
    df: DataFrame, code_map: DataFrame, column: str, out: str, key: str = "case_id",
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """A code column to its question, else its name, else the code itself."""
    return _decode_one(df, code_map, column, out, key, "question", max_rows)


def _listed(df: DataFrame, codes: str, key: str, cap: int | None, carried: list[str]) -> DataFrame:
    """One row per code, at most ``cap`` per case (None: all); a case without codes keeps one row.

    The outer form also keeps Spark from testing the list, and so parsing it, once more.
    """
    kept = F.col(codes) if cap is None else F.slice(codes, 1, cap)
    return df.select(key, *carried, F.posexplode_outer(kept).alias("_pos", "_code"))


def _regrouped(items: DataFrame, key: str, out: str, carried: list[str]) -> DataFrame:
    """One row per case: at most ``cap`` texts, back in list order."""
    pair = F.when(F.col("_text").isNotNull(), F.struct("_pos", "_text"))
    pairs = F.array_sort(F.collect_list(pair))
    return items.groupBy(key).agg(
        F.transform(pairs, lambda p: p["_text"]).alias(out), *[F.first(name).alias(name) for name in carried]
    )


def listed_texts(
    df: DataFrame, code_map: DataFrame, codes: str, cap: int, out: str, key: str = "case_id",
    variant: str = "question", carried: list[str] = (), max_rows: int = MAX_ROWS,
) -> DataFrame:
    """D6c without the other columns: (key, ``out``, what is ``carried``), one row per case."""
    texts = code_texts(code_map, variant).withColumnRenamed("code", "_code")
    items = join_dimension(_listed(df, codes, key, cap, carried), texts, "_code", key, max_rows)
    items = items.select(key, *carried, "_pos", F.coalesce("_text", "_code").alias("_text"))
    return _regrouped(items, key, out, carried)


def decode_list(
    df: DataFrame, code_map: DataFrame, codes: str, cap: int, out: str, key: str = "case_id",
    variant: str = "question", max_rows: int = MAX_ROWS,
) -> DataFrame:
    """The first ``cap`` codes of a list column as texts, and ``<out>_more``, the number left out.

    ``key`` is unique. Where ``df`` is partitioned (or bucketed) by it, nothing but ``code_map`` moves. The
    list is needed on one side of the join back only, so that it is read and parsed once.
    """
    more = f"{out}_more"
    left = F.greatest(F.coalesce(F.size(codes), F.lit(0)) - cap, F.lit(0))
    listed = df.select(key, codes, left.alias(more))
    texts = listed_texts(listed, code_map, codes, cap, out, key, variant, [more], max_rows)
    return join_rows(df, texts, key).select(*df.columns, out, more)


def _without(text: Column, words: tuple[str, ...]) -> Column:
    for word in words:
        text = F.replace(text, F.lit(word), F.lit(""))
    return text


def code_phrases(code_map: DataFrame) -> DataFrame:
    """What each code says in a case: ``_statement`` for yes/no codes, ``_by_value`` (value code to text)
    for the others. Worked out once per code, not once per case."""
    question = F.when(F.col("question_en") != "", F.col("question_en"))
    yes_no = F.coalesce(F.col("data_type") == "B", F.lit(False))
    statement = strip(_without(F.lower(question), fixed.YES_NO_WORDS))
    topic = _without(F.lower(F.substring_index(question, "?", 1)), fixed.VALUED_WORDS)
    english = F.transform_values("value_meaning", lambda code, names: F.try_element_at(names, F.lit("en")))
    spoken = F.map_filter(
        english,
        lambda code, text: (code != "") & F.coalesce(~text.isin(list(fixed.EMPTY_VALUES)), F.lit(False)),
    )
    return code_map.select(
        F.col("code").alias("_base"),
        F.when(yes_no & (F.length(statement) > 5), statement).alias("_statement"),
        F.when(
            ~yes_no & question.isNotNull(),
            F.transform_values(spoken, lambda code, text: F.concat(topic, F.lit(": "), text)),
        ).alias("_by_value"),
    )


def symptom_lines(
    df: DataFrame, code_map: DataFrame, codes: str = "codes", cap: int = fixed.SYMPTOM_CAP,
    out: str = "symptoms", key: str = "case_id", carried: list[str] = (), max_rows: int = MAX_ROWS,
) -> DataFrame:
    """D7 without the other columns: (key, ``out``, what is ``carried``), one row per case."""
    items = _listed(df, codes, key, cap, carried).select(
        key,
        *carried,
        "_pos",
        F.substring_index("_code", fixed.CODE_SEPARATOR, 1).alias("_base"),
        F.split_part("_code", F.lit(fixed.CODE_SEPARATOR), F.lit(2)).alias("_value"),
    )
    said = F.coalesce("_statement", F.try_element_at("_by_value", F.col("_value")))
    items = join_dimension(items, code_phrases(code_map), "_base", key, max_rows)
    lines = _regrouped(items.withColumn("_text", said), key, "_texts", carried)
    line = F.when(F.size("_texts") > 0, F.array_join("_texts", ", "))
    return lines.select(key, *carried, F.coalesce(line, F.lit(fixed.DEFAULT_COMPLAINT)).alias(out))


def decode_symptoms(
    df: DataFrame, code_map: DataFrame, codes: str = "codes", cap: int = fixed.SYMPTOM_CAP,
    out: str = "symptoms", key: str = "case_id", max_rows: int = MAX_ROWS,
) -> DataFrame:
    """The first ``cap`` codes of each case as one line of symptoms.

    Codes without a known question or a meaningful text say nothing; a case in which no code says
    anything gets a fixed complaint. ``key`` is unique.
    """
    lines = symptom_lines(df.select(key, codes), code_map, codes, cap, out, key, max_rows=max_rows)
    return join_rows(df, lines, key).select(*df.columns, out)


def sex_text(c: Column) -> Column:
    """``M`` is Male, everything else Female."""
    return F.when(c.eqNullSafe("M"), F.lit("Male")).otherwise(F.lit("Female"))


def severe_block(severe: DataFrame) -> DataFrame:
    """One row with the sorted bullet list of a small severe set."""
    names = F.array_sort(F.collect_set("disease"))
    lines = F.transform(names, lambda name: F.concat(F.lit("- "), name))
    return severe.agg(F.array_join(lines, "\n").alias("severe_disease_list"))


def evidence_lookup(code_map: DataFrame, variant: str) -> DataFrame:
    """``name`` gives (code, name, type) of object entries with empty defaults; ``symptom`` gives
    (code, symptom, type) with the question, else the name, else the code."""
    if variant == "name":
        return code_map.where(_other_entry(code_map).isNull()).select(
            "code",
            F.coalesce("name", F.lit("")).alias("name"),
            F.coalesce("data_type", F.lit("")).alias("type"),
        )
    if variant == "symptom":
        return code_map.select(
            "code",
            F.coalesce("question_en", "name", "code").alias("symptom"),
            F.coalesce("data_type", F.lit("unknown")).alias("type"),
        )
    raise ValueError(f"unknown variant {variant!r}")


def explode_options(qa: DataFrame) -> DataFrame:
    """One row per answer option with a mark on the right one."""
    others = [name for name in qa.columns if name != "options"]
    rows = qa.select(*others, F.explode("options").alias("option", "option_text"))
    return rows.withColumn("is_answer", F.coalesce(F.col("option") == F.col("answer_idx"), F.lit(False)))
