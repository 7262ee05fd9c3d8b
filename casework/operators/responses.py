"""Model responses to structured predictions (R1-R9). All but R8 are projections."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from casework import fixed_values as fixed
from casework.functions.json_text import STRICT, object_or_null, strict_json
from casework.functions.text import WS, first_line, strip  # noqa: F401  (R9 is first_line)

FENCE = "```"
JSON_FENCE = "```json"
FALSY = ("", "null", "false", "0", "0.0", "[]", "{}")

# The first disease and the first confidence in a response text.
DISEASE = f'"disease":[{WS}]*"([^"\\n]*)"'
CONFIDENCE = f'"confidence":[{WS}]*([0-9.]+)'


def strip_fence(c: Column) -> Column:
    """The text between the first fence and the next one; text without a fence stays."""

    def inside(fence: str) -> Column:
        return F.substring_index(F.split_part(c, F.lit(fence), F.lit(2)), FENCE, 1)

    return (
        F.when(c.contains(JSON_FENCE), inside(JSON_FENCE))
        .when(c.contains(FENCE), inside(FENCE))
        .otherwise(c)
    )


def _field(entry: Column, name: str) -> Column:
    """The value of a key, its last one where the key repeats."""
    named = F.filter(F.map_entries(entry), lambda e: e["key"] == name)
    return F.try_element_at(named, F.lit(-1))["value"]


def parse_response(df: DataFrame, column: str = "raw_model_response", head_chars: int = 50) -> DataFrame:
    """R2: adds ``predicted_disease``, ``model_confidence``, ``final_reason``, ``top_3`` (list of maps),
    ``parse_ok``, ``parse_error`` and ``parsed_model_json``.

    The final prediction comes first, then the first of the top three, then the head of the text. Text
    that is no JSON object falls back to its first line. White space around the response does not count; of
    keys that repeat in an object the last counts. ``head_chars`` is how much text a prediction may take.
    """
    raw = strip(F.col(column))
    head = F.substring(raw, 1, head_chars)
    opened = df.withColumn("_body", strip(strip_fence(raw)))
    opened = opened.withColumn("_json", strict_json(F.col("_body")))
    fields = object_or_null(
        F.col("_json"),
        "struct<top_3_predictions:array<map<string,string>>,final_prediction:map<string,string>>",
    )
    opened = opened.withColumn("_fields", fields)
    final, top = F.col("_fields.final_prediction"), F.col("_fields.top_3_predictions")
    # Looked at only where a field is missing or is not of the expected form.
    opened = opened.withColumns(
        {
            "_final_text": F.when(final.isNull(), F.get_json_object("_json", "$.final_prediction")),
            "_top_text": F.when(top.isNull(), F.get_json_object("_json", "$.top_3_predictions")),
        }
    )
    final_text, top_text = F.col("_final_text"), F.col("_top_text")
    opened = opened.withColumns(
        {
            "_final": F.coalesce(final, object_or_null(final_text, "map<string,string>")),
            "_top": F.coalesce(
                top,
                F.when(
                    top_text.startswith("["), F.from_json(top_text, "array<map<string,string>>", STRICT)
                ),
            ),
        }
    )
    final, first = F.col("_final"), F.get("_top", F.lit(0))
    said_final = F.coalesce(~final_text.isin(list(FALSY)), F.lit(False))
    said_top = F.coalesce(F.size(top) > 0, ~top_text.isin(list(FALSY)), F.lit(False))
    opened = opened.withColumns(
        {
            "_has_final": F.coalesce(F.size(final) > 0, F.lit(False)),
            "_has_top": said_top,
            "_first": first,
        }
    )
    # Something else in the place of an object is not what is expected.
    odd = (final.isNull() & said_final) | (
        ~F.col("_has_final") & F.col("_has_top") & F.col("_first").isNull()
    )
    opened = opened.withColumn("_is_object", F.col("_fields").isNotNull() & ~odd)
    is_object = F.col("_is_object")
    source = F.when(F.col("_has_final"), final).when(F.col("_has_top"), F.col("_first"))
    opened = opened.withColumn("_source", F.when(is_object, source))
    chosen = F.col("_source")
    disease = (
        F.when(~is_object, F.substring(F.substring_index(raw, "\n", 1), 1, head_chars))
        .when(F.map_contains_key(chosen, "disease"), _field(chosen, "disease"))
        .otherwise(head)
    )
    confidence = F.when(
        F.map_contains_key(chosen, "confidence"), _field(chosen, "confidence").try_cast("double")
    ).otherwise(F.lit(0.5))
    return opened.withColumns(
        {
            "predicted_disease": disease,
            "model_confidence": F.when(raw.isNotNull(), confidence),
            "final_reason": F.when(is_object, _field(final, "reason")),
            "top_3": F.when(is_object, F.col("_top")),
            "parse_ok": F.col("_json").isNotNull(),
            "parse_error": F.when(F.col("_json").isNull(), F.lit("not valid JSON")).when(
                ~is_object, F.lit("not the expected JSON object")
            ),
            "parsed_model_json": F.coalesce(F.col("_json"), F.lit("{}")),
        }
    ).drop(
        "_body", "_json", "_fields", "_final_text", "_top_text", "_final", "_top", "_has_final", "_has_top",
        "_first", "_is_object", "_source",
    )


def flatten_top3(parsed: DataFrame) -> DataFrame:
    """``rank1_disease`` to ``rank3_confidence``; absent ranks are NULL."""
    columns = {}
    for rank in (1, 2, 3):
        entry = F.get("top_3", F.lit(rank - 1))
        columns[f"rank{rank}_disease"] = _field(entry, "disease")
        columns[f"rank{rank}_confidence"] = _field(entry, "confidence").try_cast("double")
    return parsed.withColumns(columns).drop("top_3")


def matches(predicted: Column, truth: Column, require_nonempty: bool = False) -> Column:
    """Equal or contained either way, without regard to case. An empty prediction is contained in
    everything unless ``require_nonempty``; a NULL one is wrong."""
    a, b = F.lower(predicted), F.lower(truth)
    found = a.eqNullSafe(b) & a.isNotNull() | b.contains(a) | a.contains(b)
    if require_nonempty:
        found = found & (a != "")
    return F.coalesce(found, F.lit(False))


def score_match(
    flat: DataFrame, truth: str = "true_diagnosis", require_nonempty: bool = False
) -> DataFrame:
    """Adds ``diagnosis_for_accuracy``, ``is_correct``, ``correct`` (mark) and ``match_type``."""
    judged = F.coalesce(F.nullif("rank1_disease", F.lit("")), F.col("predicted_disease"))
    df = flat.withColumn("diagnosis_for_accuracy", judged)
    right = matches(F.col("diagnosis_for_accuracy"), F.col(truth), require_nonempty)
    exact = F.lower("diagnosis_for_accuracy") == F.lower(F.col(truth))
    df = df.withColumn("is_correct", right)
    return df.withColumns(
        {
            "correct": F.when(F.col("is_correct"), F.lit(fixed.RIGHT_MARK)).otherwise(
                F.lit(fixed.WRONG_MARK)
            ),
            "match_type": F.when(
                F.col("is_correct"), F.when(exact, F.lit("Exact")).otherwise(F.lit("Partial"))
            ),
        }
    )


def extract_regex(df: DataFrame, column: str = "raw_model_response") -> DataFrame:
    """``predicted_rank1_disease`` and ``predicted_rank1_confidence``, both or neither."""
    # The long text is searched once per pattern; the groups are read from what was found.
    hits = df.withColumns(
        {
            "_sure": F.regexp_substr(F.col(column), F.lit(CONFIDENCE)),
            "_named": F.regexp_substr(F.col(column), F.lit(DISEASE)),
        }
    )
    found = hits.withColumns(
        {
            "_number": F.regexp_extract("_sure", CONFIDENCE, 1).try_cast("double"),
            "_disease": F.when(F.col("_named").isNotNull(), F.regexp_extract("_named", DISEASE, 1)),
        }
    )
    both = F.col("_number").isNotNull() & F.col("_disease").isNotNull()
    return found.withColumns(
        {
            "predicted_rank1_disease": F.when(both, F.col("_disease")),
            "predicted_rank1_confidence": F.when(both, F.col("_number")),
        }
    ).drop("_sure", "_named", "_number", "_disease")


def is_referral(c: Column) -> Column:
    """Exactly the referral text."""
    return c.eqNullSafe(fixed.REFER)


def assemble_results(scored: DataFrame) -> DataFrame:
    """The 30 columns of a results row."""
    return scored.select(
        "case_num",
        F.col("case_id").alias("original_test_index"),
        F.col("AGE").alias("age"),
        F.col("sex_text").alias("sex"),
        "symptoms",
        "num_evidences",
        F.col("EVIDENCES").alias("raw_evidences"),
        F.col("DIFFERENTIAL_DIAGNOSIS").alias("raw_differential_diagnosis"),
        "true_diagnosis",
        "diagnosis_options",
        "num_diagnosis_options",
        "confidence_threshold",
        "severe_disease_list",
        "rank1_disease",
        "rank1_confidence",
        "rank2_disease",
        "rank2_confidence",
        "rank3_disease",
        "rank3_confidence",
        F.col("predicted_disease").alias("final_prediction"),
        F.col("model_confidence").alias("final_confidence"),
        "final_reason",
        is_referral(F.col("predicted_disease")).alias("final_is_referral"),
        "diagnosis_for_accuracy",
        F.col("correct").alias("diagnostic_correct"),
        "correct",
        "parse_ok",
        "parse_error",
        "raw_model_response",
        "parsed_model_json",
    )


def block_totals(
    df: DataFrame, order: str = "case_num", right: str = "is_correct", every: int = 50
) -> DataFrame:
    """Cases and correct ones of each block of ``every`` case numbers, from 1; sums that may be added to."""
    block = F.floor((F.col(order) - 1) / every)
    return df.groupBy(block.alias("block")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col(right)).alias("_right")
    )


def accumulated(blocks: DataFrame, blocks_per_span: int = 10_000) -> DataFrame:
    """(cases, correct, accuracy) up to each block of ``block_totals``.

    Spans of blocks are summed first; only their totals, one row per ``blocks_per_span`` blocks, are added up in one task.
    """
    blocks = blocks.withColumn("_span", F.floor(F.col("block") / blocks_per_span))
    before = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = blocks.groupBy("_span").agg(F.sum("_n").alias("_sn"), F.sum("_right").alias("_sr"))
    spans = spans.select(
        "_span",
        F.coalesce(F.sum("_sn").over(before), F.lit(0)).alias("_n_before"),
        F.coalesce(F.sum("_sr").over(before), F.lit(0)).alias("_right_before"),
    )
    upto = Window.partitionBy("_span").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.join(spans, "_span").select(
        (F.col("_n_before") + F.sum("_n").over(upto)).alias("cases"),
        (F.col("_right_before") + F.sum("_right").over(upto)).alias("correct"),
    ).withColumn("accuracy", F.col("correct") / F.col("cases") * 100)


def running_accuracy(
    df: DataFrame, order: str = "case_num", right: str = "is_correct", every: int = 50,
    blocks_per_span: int = 10_000,
) -> DataFrame:
    """(cases, correct, accuracy) after each block of ``every`` case numbers; ``order`` counts from 1.

    A block holds the cases whose numbers are in it, however many are missing; the last may be unfinished.
    """
    return accumulated(block_totals(df, order, right, every), blocks_per_span)
