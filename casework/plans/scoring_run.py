"""End-to-end runs: cases to prompts, responses to results, results to Pass@1."""

from pyspark.sql import Column, DataFrame, functions as F

from casework.operators.decision import (
    SEVERE_DEFAULT, Severe, count_options, decide_with_reason, dynamic_threshold, mark_severe, refer_reason,
    scoring_columns, to_scoring,
)
from casework.operators.decoding import severe_block
from casework.operators.dimension import fits_in_memory, join_rows
from casework.operators.evaluation import normalise_scored
from casework.operators.records import (
    prepare_cases, system_prompt, to_messages, user_prompt, user_prompt_rules,
)
from casework.operators.responses import (
    assemble_results, extract_regex, flatten_top3, matches, parse_response, score_match,
)
from casework.operators.sampling import sample_n
from casework.session import written


def severe_text(severe: Severe) -> Column:
    """The bullet list of a severe set as a literal or a scalar subquery."""
    if isinstance(severe, DataFrame):
        return severe_block(severe).scalar()
    return F.lit("\n".join(f"- {name}" for name in sorted(severe)))


def prompts(
    cases: DataFrame, code_map: DataFrame, n: int = 1000, seed: int = 42, rules: bool = False,
    severe: Severe = SEVERE_DEFAULT,
) -> DataFrame:
    """Sample ``n`` cases and write their chat messages; everything after the sample is small.

    The sample is written to the shared folder once, as its cells are read on both sides of a join."""
    sampled, _ = written(sample_n(cases, n, seed, "case_id"), "sample")
    prepared = prepare_cases(sampled, code_map)
    if rules:
        asked = user_prompt_rules(prepared, severe_text(severe))
        return to_messages(asked, {"system": system_prompt(), "user": F.col("user_prompt")})
    asked = user_prompt(prepared).withColumn("severe_disease_list", severe_text(severe))
    return to_messages(asked, {"user": F.col("user_prompt")})


def score_run(asked: DataFrame, responses: DataFrame, few: bool = False) -> DataFrame:
    """Join responses (case_id, raw_model_response) to the asked cases and build the results table.

    Both sides meet on the unique case id; a case without a response stays, unanswered. With ``few``, such as
    a sample, the asked ids are measured, and sent to the responses so that only theirs move on."""
    if few:
        ids = asked.select("case_id")
        if fits_in_memory(ids):
            responses = responses.join(F.broadcast(ids), "case_id", "left_semi")
    answered = join_rows(asked, responses.select("case_id", "raw_model_response"), "case_id", "left")
    answered = answered.withColumn("true_diagnosis", F.col("PATHOLOGY"))
    return assemble_results(score_match(flatten_top3(parse_response(answered))))


def _extracted(results: DataFrame) -> DataFrame:
    n = count_options(F.col("diagnosis_options"))
    counted = results.withColumn("number_of_options", n).withColumn(
        "threshold", dynamic_threshold(F.col("number_of_options"))
    )
    return extract_regex(counted)


def decide_run(
    results: DataFrame, severe: Severe = SEVERE_DEFAULT, missing: str = "pass",
    severe_of: str = "predicted",
) -> DataFrame:
    """The decision layer on results rows (case_id, true_diagnosis, diagnosis_options,
    raw_model_response), in the columns that scoring reads. Projections only, besides the severe set."""
    decided = decide_with_reason(_extracted(results), severe, missing)
    right = matches(F.col("predicted_rank1_disease"), F.col("true_diagnosis"))
    return to_scoring(decided, right, severe_of, severe)


def scored_run(results: DataFrame, **options) -> DataFrame:
    """``decide_run`` with the types that the evaluation expects."""
    return normalise_scored(decide_run(results, **options))


def scored_phases(results: DataFrame, phases: dict[str, dict]) -> DataFrame:
    """``scored_run`` of one run under several options (name -> options), with a ``phase`` column, from one scan.

    Responses are read and severe sets looked up once, each phase is an element of a row's outcomes.
    """
    right = matches(F.col("predicted_rank1_disease"), F.col("true_diagnosis"))
    rows = _extracted(results).withColumn("_right", right)
    columns = {"predicted": "predicted_rank1_disease", "true": "true_diagnosis"}
    marks: dict[tuple, str] = {}
    outcomes = []
    for phase, options in phases.items():
        severe, names = options.get("severe", SEVERE_DEFAULT), {}
        for of in ("predicted", options.get("severe_of", "predicted")):
            if of not in columns:
                raise ValueError(f"unknown severity source {of!r}")
            known = id(severe), of
            if known not in marks:
                marks[known] = f"_severe_{len(marks)}"
                rows = mark_severe(rows, columns[of], severe, marks[known])
            names[of] = F.col(marks[known])
        reason = refer_reason(names["predicted"], options.get("missing", "pass"))
        is_severe = names[options.get("severe_of", "predicted")]
        scored = scoring_columns(F.col("_right"), is_severe, reason)
        outcomes.append(F.struct(F.lit(phase).alias("phase"), *scored))
    each = rows.select("case_id", F.explode(F.array(*outcomes)).alias("o")).select("case_id", "o.*")
    return normalise_scored(each)
