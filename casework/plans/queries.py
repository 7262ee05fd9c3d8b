"""One query per operator over the whole given tables, with flat output columns."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from casework import fixed_values as fixed
from casework.functions import lists
from casework.functions.text import word_count
from casework.operators import (
    decision, decoding, evaluation, profiling, records, responses as resp, sampling,
)
from casework.plans import adapters, scoring_run
from casework.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TERMS = ("er", "the", "on", "ent", "ion")
POSITIONS = [0, 100, 500, 1000, 10000, 50000, 100000]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _joined(items: Column, separator: str = "|") -> Column:
    return F.array_join(items, separator)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(F.col(name), 6) for name in names})


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.col(name).cast("long") for name in names})


# Sources


@query
def s1_load_cases(spark, sf_dir):
    return _long(adapters.cases(spark, sf_dir), "AGE")


POSITIONED = {
    "orders": "case_id long, o_custkey long, o_orderdate date",
    "documents": "qa_id long, lang string, n_chars long",
}


def _by_position(spark, sf_dir, name, load, key):
    """A given file, which has no such id, by the loader."""
    declared = T.StructType.fromDDL(POSITIONED[name])
    return load(spark, {"all": f"{sf_dir}/{name}.parquet"}, declared=declared, key=key)


@query
def s1_load_cases_by_position(spark, sf_dir):
    rows = _by_position(spark, sf_dir, "orders", readers.load_cases, "case_id")
    return rows.select("case_id", "o_custkey", F.year("o_orderdate").cast("long").alias("year"), "split")


@query
def s3_load_qa_by_position(spark, sf_dir):
    return _by_position(spark, sf_dir, "documents", readers.load_qa, "qa_id")


@query
def s4_catalog_rows(spark, sf_dir):
    """Lists of paths per category, as a catalog holds them, in rows."""
    nation = adapters.table(spark, sf_dir, "nation")
    paths = F.sort_array(F.collect_list(F.concat_ws("/", F.col("n_regionkey").cast("string"), "n_name")))
    return readers.catalog_rows(nation.groupBy(F.col("n_regionkey").cast("string").alias("category")).agg(paths.alias("paths")))


@query
def s2_code_entries(spark, sf_dir):
    entries = readers.code_entries(adapters.code_entry_texts(spark, sf_dir))
    said = F.try_element_at(F.try_element_at("value_meaning", F.lit("V_1")), F.lit("en"))
    return entries.select(
        "code", "name", "question_en", "data_type", said.alias("first_value"), "entry_text"
    )


@query
def s5_split_corpus_docs(spark, sf_dir):
    docs, _ = readers.split_corpus(adapters.corpus_files(spark, sf_dir))
    return docs


@query
def s5_split_corpus_failures(spark, sf_dir):
    _, failures = readers.split_corpus(adapters.corpus_files(spark, sf_dir))
    return failures


# Sampling


@query
def p1_sample_n(spark, sf_dir):
    cases = adapters.cases(spark, sf_dir).select("case_id", "split", "PATHOLOGY")
    return sampling.sample_n(cases, 1000, 42, "case_id")


@query
def p2_shuffle_take(spark, sf_dir):
    cases = adapters.cases(spark, sf_dir).select("case_id", "split", "PATHOLOGY")
    return sampling.shuffle_take(cases, {"train": 5000, "validate": 500}, 42, "case_id")


@query
def p3_take_first(spark, sf_dir):
    cases = adapters.cases(spark, sf_dir).select("case_id", "EVIDENCES")
    return sampling.take_first(cases, 1000, "case_id")


@query
def p3_take_positions(spark, sf_dir):
    cases = adapters.cases(spark, sf_dir).select("case_id", "PATHOLOGY")
    return sampling.take_positions(cases, "case_id", POSITIONS)


@query
def p4a_sample_fraction_per_group(spark, sf_dir):
    corpus = adapters.corpus(spark, sf_dir).select("lang", "doc_id", "path")
    return sampling.sample_fraction_per_group(corpus, "lang", "doc_id", 0.05)


@query
def p4a_fraction_stats(spark, sf_dir):
    return sampling.fraction_stats(adapters.corpus(spark, sf_dir), "category", 0.05)


@query
def p4b_top_n_per_group(spark, sf_dir):
    corpus = adapters.corpus(spark, sf_dir).select("category", "doc_id", "path")
    return sampling.top_n_per_group(corpus, "category", "doc_id", 3)


@query
def p4c_filter_groups(spark, sf_dir):
    corpus = adapters.corpus(spark, sf_dir).select("category", "path")
    return sampling.filter_groups(corpus, "category", ["src1", "src2", "no such source"])


@query
def p5_quantile_exemplars(spark, sf_dir):
    docs = adapters.corpus(spark, sf_dir).select("doc_id", word_count(F.col("text")).alias("words"))
    return _long(sampling.quantile_exemplars(docs, "words", "doc_id"), "words")


# Parsing and decoding


@query
def d1_parse_list_json(spark, sf_dir):
    df = adapters.cases(spark, sf_dir)
    codes = lists.parse_list(F.col("EVIDENCES_JSON"), "json")
    return df.select("case_id", codes.alias("l")).select(
        "case_id", F.size("l").cast("long").alias("n"), _joined(F.col("l")).alias("codes")
    )


@query
def d2_parse_list_literal(spark, sf_dir):
    df = adapters.cases(spark, sf_dir)
    parsed = df.select(
        "case_id", "EVIDENCES", lists.parse_list(F.col("EVIDENCES"), "literal").alias("l")
    )
    return parsed.select(
        "case_id",
        F.size("l").cast("long").alias("n"),
        _joined(F.col("l")).alias("codes"),
        lists.parse_error(F.col("l"), F.col("EVIDENCES")).alias("parse_error"),
    )


@query
def d3_parse_list_safe(spark, sf_dir):
    df = adapters.cases(spark, sf_dir)
    codes = lists.parse_list(F.col("EVIDENCES"), "safe")
    return df.select("case_id", _joined(codes).alias("codes"))


@query
def d4a_parse_differential(spark, sf_dir):
    df = adapters.cases(spark, sf_dir)
    pairs = lists.parse_differential(F.col("DIFFERENTIAL_JSON"))
    exploded = df.select("case_id", F.posexplode(pairs).alias("pos", "p"))
    return _long(exploded.select("case_id", "pos", "p.disease", "p.probability"), "pos")


@query
def d4b_differential_names(spark, sf_dir):
    """Options, their count, the numbered text and the threshold."""
    df = adapters.literal_cases(spark, sf_dir)
    items = lists.differential_items(F.col("DIFFERENTIAL_DIAGNOSIS"), "literal")
    df = df.select("case_id", "PATHOLOGY", items.alias("items"))
    df = df.withColumn("names", lists.differential_names(F.col("items"), F.col("PATHOLOGY")))
    threshold = F.when(F.col("items").isNull(), F.lit(1.0)).otherwise(
        decision.dynamic_threshold(F.size("names"))
    )
    return df.select(
        "case_id",
        _joined(F.col("names")).alias("names"),
        F.size("names").cast("long").alias("num_options"),
        lists.option_text(F.col("names")).alias("diagnosis_options"),
        threshold.alias("confidence_threshold"),
    )


@query
def d4c_top_differential(spark, sf_dir):
    df = adapters.cases(spark, sf_dir)
    top = lists.top_differential(lists.parse_differential(F.col("DIFFERENTIAL_JSON")), 3)
    rows = df.select("case_id", F.posexplode(top).alias("pos", "p"))
    return _long(rows.select("case_id", "pos", "p.disease", "p.probability_text"), "pos")


@query
def d5_clean_differential(spark, sf_dir):
    df = adapters.literal_cases(spark, sf_dir)
    names = lists.clean_differential(F.col("DIFFERENTIAL_DIAGNOSIS"))
    return df.select("case_id", _joined(names).alias("names"))


@query
def d2_printed_list(spark, sf_dir):
    """D2 on tuples with ``True`` and last commas."""
    codes = lists.parse_list(F.col("EVIDENCES"), "literal")
    df = adapters.printed_cases(spark, sf_dir).select("case_id", codes.alias("l"))
    return df.select("case_id", F.size("l").cast("long").alias("n"), _joined(F.col("l")).alias("codes"))


@query
def d4b_printed_differential(spark, sf_dir):
    """D4b on lists, tuples, names and ``None`` in one cell."""
    df = adapters.printed_cases(spark, sf_dir)
    items = lists.differential_items(F.col("DIFFERENTIAL_DIAGNOSIS"), "literal")
    names = lists.differential_names(items, F.col("PATHOLOGY"))
    return df.select("case_id", _joined(names).alias("names"), items.isNull().alias("unreadable"))


@query
def d5_printed_differential(spark, sf_dir):
    """D5 on the same cells."""
    names = lists.clean_differential(F.col("DIFFERENTIAL_DIAGNOSIS"))
    return adapters.printed_cases(spark, sf_dir).select("case_id", _joined(names).alias("names"))


@query
def d6a_decode_name(spark, sf_dir):
    cases = adapters.cases(spark, sf_dir).select("case_id", "INITIAL_EVIDENCE")
    codes = adapters.code_map(spark, sf_dir)
    return decoding.decode_name(cases, codes, "INITIAL_EVIDENCE", "complaint")


@query
def d6b_decode_question(spark, sf_dir):
    cases = adapters.cases(spark, sf_dir).select("case_id", "INITIAL_EVIDENCE")
    codes = adapters.code_map(spark, sf_dir)
    return decoding.decode_question(cases, codes, "INITIAL_EVIDENCE", "complaint")


@query
def d6c_decode_list(spark, sf_dir):
    cases = adapters.json_cases(spark, sf_dir)
    cases = cases.select("case_id", lists.list_column(cases, "EVIDENCES", "json").alias("codes"))
    shown = decoding.decode_list(cases, adapters.code_map(spark, sf_dir), "codes", 8, "texts")
    return shown.select(
        "case_id", _joined(F.col("texts")).alias("texts"), F.col("texts_more").cast("long").alias("more")
    )


@query
def d7_decode_symptoms(spark, sf_dir):
    cases = adapters.literal_cases(spark, sf_dir)
    cases = cases.select("case_id", lists.list_column(cases, "EVIDENCES", "literal").alias("codes"))
    return decoding.decode_symptoms(cases, adapters.code_map(spark, sf_dir)).drop("codes")


@query
def d8_sex_text(spark, sf_dir):
    return adapters.gap_cases(spark, sf_dir).select(
        "case_id", decoding.sex_text(F.col("SEX")).alias("sex")
    )


@query
def d10_severe_block(spark, sf_dir):
    return decoding.severe_block(adapters.severe(spark, sf_dir))


@query
def d11_evidence_lookup_name(spark, sf_dir):
    return decoding.evidence_lookup(adapters.code_map(spark, sf_dir), "name")


@query
def d11_evidence_lookup_symptom(spark, sf_dir):
    return decoding.evidence_lookup(adapters.code_map(spark, sf_dir), "symptom")


@query
def d12_explode_options(spark, sf_dir):
    return decoding.explode_options(adapters.qa(spark, sf_dir).drop("question"))


@query
def d13_normalise_evidence(spark, sf_dir):
    cases = adapters.literal_cases(spark, sf_dir)
    evidence = lists.normalise_evidence(cases, "INITIAL_EVIDENCE")
    return cases.select("case_id", F.size(evidence).cast("long").alias("n"), _joined(evidence).alias("codes"))


# Records


@query
def f1_training_record_a(spark, sf_dir):
    df = records.training_record_a(
        adapters.json_cases(spark, sf_dir), adapters.code_map(spark, sf_dir)
    )
    return _long(
        df.select(
            "case_id", "instruction", "input", "output", F.col("metadata.age").alias("age"),
            F.col("metadata.sex").alias("sex"), F.col("metadata.pathology").alias("pathology"),
        ),
        "age",
    )


@query
def f2_training_record_b(spark, sf_dir):
    return records.training_record_b(adapters.literal_cases(spark, sf_dir))


@query
def f3_user_prompt(spark, sf_dir):
    prepared = records.prepare_cases(
        adapters.literal_cases(spark, sf_dir), adapters.code_map(spark, sf_dir)
    )
    return records.user_prompt(prepared).select("case_id", "user_prompt")


@query
def f4_user_prompt_rules(spark, sf_dir):
    prepared = records.prepare_cases(
        adapters.literal_cases(spark, sf_dir), adapters.code_map(spark, sf_dir)
    )
    text = scoring_run.severe_text(adapters.severe(spark, sf_dir))
    return records.user_prompt_rules(prepared, text).select("case_id", "user_prompt")


@query
def f6_to_messages(spark, sf_dir):
    labels = records.training_record_b(adapters.literal_cases(spark, sf_dir))
    chat = records.to_messages(
        labels,
        {"system": F.col("instruction"), "user": F.col("input"), "assistant": F.col("output")},
    )
    rows = chat.select("case_id", F.posexplode("messages").alias("pos", "m"))
    return _long(rows.select("case_id", "pos", "m.role", "m.content"), "pos")


# Responses


@query
def r1_strip_fence(spark, sf_dir):
    return adapters.responses(spark, sf_dir).select(
        "case_id", resp.strip_fence(F.col("raw_model_response")).alias("body")
    )


@query
def r2_parse_response(spark, sf_dir):
    parsed = resp.parse_response(adapters.responses(spark, sf_dir))
    return parsed.select(
        "case_id", "predicted_disease", "model_confidence", "final_reason", "parse_ok", "parse_error"
    )


@query
def r3_flatten_top3(spark, sf_dir):
    flat = resp.flatten_top3(resp.parse_response(adapters.responses(spark, sf_dir)))
    return flat.select(
        "case_id",
        *[f"rank{n}_{part}" for n in (1, 2, 3) for part in ("disease", "confidence")],
        "final_reason",
    )


@query
def r4_score_match(spark, sf_dir):
    flat = resp.flatten_top3(resp.parse_response(adapters.responses(spark, sf_dir)))
    return resp.score_match(flat).select(
        "case_id", "diagnosis_for_accuracy", "is_correct", "correct", "match_type"
    )


@query
def r5_extract_regex(spark, sf_dir):
    return resp.extract_regex(adapters.responses(spark, sf_dir)).select(
        "case_id", "predicted_rank1_disease", "predicted_rank1_confidence"
    )


@query
def r6_is_referral(spark, sf_dir):
    parsed = resp.parse_response(adapters.responses(spark, sf_dir))
    return parsed.select("case_id", resp.is_referral(F.col("predicted_disease")).alias("is_referral"))


def _results(asked, spark, sf_dir, few=False):
    """The results table without the cells that repeat its input."""
    results = scoring_run.score_run(asked, adapters.responses(spark, sf_dir), few)
    return _long(results, "age", "num_evidences", "num_diagnosis_options").drop(
        "raw_evidences", "raw_differential_diagnosis", "raw_model_response", "parsed_model_json"
    )


@query
def r7_assemble_results(spark, sf_dir):
    """Every case asked and scored."""
    prepared = records.prepare_cases(
        adapters.literal_cases(spark, sf_dir), adapters.code_map(spark, sf_dir)
    )
    text = scoring_run.severe_text(adapters.severe(spark, sf_dir))
    asked = prepared.withColumn("severe_disease_list", text).withColumn("case_num", F.col("case_id") + 1)
    return _results(asked, spark, sf_dir)


@query
def a1_sampled_run(spark, sf_dir):
    """Entry A: sample 1,000 cases, ask them with the rules, score them."""
    asked = scoring_run.prompts(
        adapters.literal_cases(spark, sf_dir), adapters.code_map(spark, sf_dir), n=1000, rules=True,
        severe=adapters.severe(spark, sf_dir),
    )
    return _results(asked, spark, sf_dir, few=True)


@query
def a1_messages(spark, sf_dir):
    """The messages of the sampled run, by role."""
    asked = scoring_run.prompts(
        adapters.literal_cases(spark, sf_dir), adapters.code_map(spark, sf_dir), n=1000, rules=True,
        severe=adapters.severe(spark, sf_dir),
    )
    said = asked.select("case_id", F.posexplode("messages").alias("pos", "m"))
    return _long(said.select("case_id", "pos", "m.role", "m.content"), "pos")




@query
def r8_running_accuracy(spark, sf_dir):
    run = adapters.run_results(spark, sf_dir)
    scored = resp.score_match(resp.flatten_top3(resp.parse_response(run)))
    return resp.running_accuracy(scored.select("case_num", "is_correct"))


@query
def r8_running_accuracy_gaps(spark, sf_dir):
    """The same over case numbers of which single ones and whole blocks are missing."""
    run = adapters.run_results(spark, sf_dir).where("case_num % 7 <> 3 and (case_num - 1) div 50 % 11 <> 5")
    scored = resp.score_match(resp.flatten_top3(resp.parse_response(run)))
    return resp.running_accuracy(scored.select("case_num", "is_correct"))


@query
def r9_first_line(spark, sf_dir):
    return adapters.responses(spark, sf_dir).select(
        "case_id", resp.first_line(F.col("raw_model_response")).alias("label")
    )


# Decision layer


@query
def l1_count_options(spark, sf_dir):
    """L1, L1b and L2 on the option text of each case."""
    n = decision.count_options(F.col("diagnosis_options"))
    return adapters.run_results(spark, sf_dir).select(
        "case_id",
        n.cast("long").alias("number_of_options"),
        _joined(decision.option_names(F.col("diagnosis_options"))).alias("option_names"),
    )


@query
def l2_dynamic_threshold(spark, sf_dir):
    n = decision.count_options(F.col("diagnosis_options"))
    return adapters.run_results(spark, sf_dir).select(
        "case_id", decision.dynamic_threshold(n).alias("threshold")
    )


def _thresholds(spark, sf_dir):
    n = decision.count_options(F.col("diagnosis_options"))
    run = adapters.run_results(spark, sf_dir).withColumn("threshold", decision.dynamic_threshold(n))
    return resp.extract_regex(run)


@query
def l3_decide(spark, sf_dir):
    decided = decision.decide(_thresholds(spark, sf_dir), adapters.severe(spark, sf_dir))
    return decided.select("case_id", "rank1_disease", "rank1_confidence")


@query
def l4_decide_with_reason(spark, sf_dir):
    decided = decision.decide_with_reason(
        _thresholds(spark, sf_dir), adapters.severe(spark, sf_dir), missing="refer"
    )
    return decided.select("case_id", "is_severe", "decision", "refer_reason")


@query
def l3b_severe_default(spark, sf_dir):
    """Marks against the built-in severe set, for its own names and others."""
    names = F.array(*[F.lit(name) for name in sorted(decision.SEVERE_DEFAULT)])
    said = F.get(names, (F.col("case_id") % (len(decision.SEVERE_DEFAULT) + 3)).cast("int"))
    run = adapters.run_results(spark, sf_dir).select(
        "case_id", F.coalesce(said, F.lit("Flu")).alias("predicted_rank1_disease"),
        F.lit(0.9).alias("predicted_rank1_confidence"), F.lit(0.5).alias("threshold"),
    )
    return decision.decide_with_reason(run).select("case_id", "is_severe", "decision")


@query
def l5_to_scoring(spark, sf_dir):
    run = adapters.run_results(spark, sf_dir)
    return _long(scoring_run.decide_run(run, severe=adapters.severe(spark, sf_dir)), "num_options")


# Evaluation


def _scored(spark, sf_dir, **options):
    run = adapters.run_results(spark, sf_dir)
    return scoring_run.scored_run(run, severe=adapters.severe(spark, sf_dir), **options)


@query
def e1_normalise_scored(spark, sf_dir):
    df = evaluation.normalise_scored(adapters.scored(spark, sf_dir))
    return df.select(
        "case_id", "correct", "confidence", "num_options", "is_referral", "is_severe", "high_confidence"
    )


@query
def e2_threshold_stats(spark, sf_dir):
    return _rounded(evaluation.threshold_stats(_scored(spark, sf_dir)), "threshold_mean")


@query
def e3_passk_flags(spark, sf_dir):
    df = evaluation.passk_flags(evaluation.normalise_scored(adapters.scored(spark, sf_dir)))
    return df.select(
        "case_id", "above_threshold", "severe_not_referred", "success_correct_dx",
        "success_severe_referred", "success_low_conf_referred", "pass_at_1_success",
        *evaluation.FAILURES,
    )


@query
def e4_passk_summary(spark, sf_dir):
    summary = evaluation.passk_summary(evaluation.passk_flags(_scored(spark, sf_dir)))
    return evaluation.assert_partition(summary)


@query
def e6_decision_breakdown(spark, sf_dir):
    return evaluation.decision_breakdown(_scored(spark, sf_dir))


@query
def e7_refer_reasons(spark, sf_dir):
    return evaluation.refer_reasons(_scored(spark, sf_dir))


@query
def e8_safety_check(spark, sf_dir):
    return _rounded(
        evaluation.safety_check(_scored(spark, sf_dir)), "diagnosed_accuracy", "referred_accuracy"
    )


@query
def e9_calibration(spark, sf_dir):
    return _rounded(
        evaluation.calibration(_scored(spark, sf_dir)),
        "confidence_all", "confidence_correct", "confidence_wrong",
    )


def _matched(spark, sf_dir):
    run = adapters.run_results(spark, sf_dir)
    return resp.score_match(resp.flatten_top3(resp.parse_response(run)))


@query
def e10_accuracy(spark, sf_dir):
    return evaluation.accuracy(_matched(spark, sf_dir))


@query
def e10_label_accuracy(spark, sf_dir):
    return evaluation.label_accuracy(_matched(spark, sf_dir), "true_diagnosis", "rank1_disease")


@query
def e11_prf(spark, sf_dir):
    return evaluation.prf(_matched(spark, sf_dir))


@query
def e11_prf_averages(spark, sf_dir):
    averages = evaluation.prf_averages(evaluation.prf(_matched(spark, sf_dir)))
    return _rounded(averages, *averages.columns)


@query
def e12_outcome_table(spark, sf_dir):
    summary = evaluation.passk_summary(evaluation.passk_flags(_scored(spark, sf_dir)))
    return evaluation.outcome_table(summary)


def _phases(spark, sf_dir):
    severe = adapters.severe(spark, sf_dir)
    phases = {
        "no severe set": {"severe": []},
        "missing passes": {"severe": severe},
        "missing refers": {"severe": severe, "missing": "refer"},
        "severe truth": {"severe": severe, "severe_of": "true"},
    }
    return evaluation.passk_flags(scoring_run.scored_phases(adapters.run_results(spark, sf_dir), phases))


@query
def e13_compare_phases(spark, sf_dir):
    return evaluation.passk_summary(_phases(spark, sf_dir), by="phase")


@query
def e13_outcome_margins(spark, sf_dir):
    """Phase, decision, reason and severity, with all margins."""
    return evaluation.outcome_margins(_phases(spark, sf_dir))


@query
def f6_conversation_messages(spark, sf_dir):
    """Chats of several turns, which the given table holds."""
    chats = records.conversation_messages(adapters.table(spark, sf_dir, "conversations"), size=4)
    said = F.transform("messages", lambda m: F.concat_ws(": ", m["role"], m["content"]))
    return chats.select("conv_id", "part", F.size("messages").cast("long").alias("turns"), _joined(said, "\n").alias("messages"))


@query
def e14_run_report(spark, sf_dir):
    report = evaluation.run_report(_scored(spark, sf_dir))
    return _rounded(
        report, "threshold_mean", "diagnosed_accuracy", "referred_accuracy", "confidence_all",
        "confidence_correct", "confidence_wrong",
    )


# Profiles


@query
def q1_split_sizes(spark, sf_dir):
    return profiling.split_sizes(adapters.cases(spark, sf_dir))


@query
def q2_field_profile(spark, sf_dir):
    profile = profiling.field_profile(adapters.qa(spark, sf_dir).drop("question"), "qa_id")
    return _long(profile, "length")


@query
def q3_value_counts(spark, sf_dir):
    return profiling.value_counts(adapters.gap_cases(spark, sf_dir), "PATHOLOGY", "case_id", 15)


@query
def q4a_balance_top(spark, sf_dir):
    return profiling.balance_top(adapters.cases(spark, sf_dir), "PATHOLOGY")


@query
def q4b_balance_band(spark, sf_dir):
    return profiling.balance_band(adapters.qa(spark, sf_dir))


@query
def q5_evidence_counts(spark, sf_dir):
    cases = adapters.literal_cases(spark, sf_dir)
    cases = cases.select("case_id", lists.list_column(cases, "EVIDENCES", "literal").alias("codes"))
    return profiling.evidence_counts(cases, "codes", "case_id", 20)


@query
def q6_numeric_stats(spark, sf_dir):
    events = adapters.table(spark, sf_dir, "events").select("event_type", "value")
    return _rounded(profiling.numeric_stats(events, "value", ["event_type"]), "mean", "median")


@query
def q6_numeric_stats_all(spark, sf_dir):
    ages = profiling.numeric_stats(adapters.gap_cases(spark, sf_dir), "AGE")
    return _long(ages, "min", "max")


@query
def q7_category_share(spark, sf_dir):
    return profiling.category_share(adapters.gap_cases(spark, sf_dir), "SEX")


@query
def q7_category_share_shown(spark, sf_dir):
    return profiling.category_share(adapters.gap_cases(spark, sf_dir), "SEX", "shown")


@query
def q8_completeness(spark, sf_dir):
    return profiling.completeness(adapters.gap_cases(spark, sf_dir))


@query
def q9_qa_checklist(spark, sf_dir):
    return profiling.qa_checklist(adapters.qa(spark, sf_dir))


@query
def q9_qa_checklist_every_row(spark, sf_dir):
    return profiling.qa_checklist(adapters.qa(spark, sf_dir), every_row=True)


@query
def q10_answer_distribution(spark, sf_dir):
    return profiling.answer_distribution(adapters.qa(spark, sf_dir))


@query
def q11_length_stats(spark, sf_dir):
    stats = profiling.length_stats(adapters.corpus(spark, sf_dir), "text", ["lang"])
    return _rounded(stats, "mean", "std")


@query
def q12_length_bands_qa(spark, sf_dir):
    return profiling.length_bands(adapters.qa(spark, sf_dir), "question", fixed.QA_BANDS, ["split"])


@query
def q12_length_bands_corpus(spark, sf_dir):
    return profiling.length_bands(adapters.corpus(spark, sf_dir), "text", fixed.CORPUS_BANDS)


@query
def q13_qa_quality(spark, sf_dir):
    return profiling.qa_quality(adapters.qa(spark, sf_dir))


@query
def q14_duplicate_count(spark, sf_dir):
    return profiling.duplicate_count(adapters.qa(spark, sf_dir), "question", ["split"])


@query
def q15_term_counts(spark, sf_dir):
    return profiling.term_counts(adapters.corpus(spark, sf_dir), "text", TERMS)


@query
def q16_corpus_quality(spark, sf_dir):
    return profiling.corpus_quality(adapters.corpus(spark, sf_dir), "text", TERMS)


@query
def q17_histogram(spark, sf_dir):
    events = adapters.table(spark, sf_dir, "events").select("value")
    return _long(profiling.histogram(events, "value", 30), "bin")


@query
def q17_histogram_by_split(spark, sf_dir):
    qa = adapters.qa(spark, sf_dir).select("split", word_count(F.col("question")).alias("words"))
    return _long(profiling.histogram(qa, "words", 50, ["split"]), "bin")


@query
def q18_box_summary(spark, sf_dir):
    events = adapters.table(spark, sf_dir, "events").select("event_type", "value")
    return _rounded(profiling.box_summary(events, "value", ["event_type"]), "q1", "median", "q3")


@query
def q19_load_rates(spark, sf_dir):
    docs = adapters.corpus(spark, sf_dir)
    failed = adapters.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("path"))
    catalog = adapters.table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("category"), F.col("url").alias("path")
    ).unionByName(docs.select("category", "path"))
    return profiling.load_rates(docs, failed, catalog)


@query
def q20_dataset_info(spark, sf_dir):
    info = profiling.dataset_info(adapters.qa(spark, sf_dir), "documents")
    rows = info.select(
        "source", F.explode("splits").alias("split", "rows"), "total_examples",
        _joined(F.col("fields"), ", ").alias("fields"), "sample_question_length",
    )
    return _long(rows, "sample_question_length")
