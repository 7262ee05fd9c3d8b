"""Small tables with expected values worked out by hand, one test per trap."""

import ast
import json
import math

import pytest
from pyspark.sql import functions as F

from casework import fixed_values as fixed
from casework.functions import lists
from casework.functions.json_text import strict_json
from casework.functions.text import first_line, is_blank, line_count, strip, to_number, word_count
from casework.operators import decision, decoding, evaluation, profiling, records, responses, sampling

X = None


@pytest.fixture(autouse=True)
def column(spark):
    global X
    X = F.col("x")



def scored(spark, rows):
    return spark.createDataFrame(
        rows,
        "case_id long, correct boolean, confidence double, num_options double, is_referral boolean, "
        "is_severe boolean",
    )


def test_missing_confidence_is_never_above(spark):
    df = scored(spark, [(1, True, None, 5.0, False, False), (2, True, 0.9, 5.0, False, False)])
    flags = {r["case_id"]: r for r in evaluation.passk_flags(df).collect()}
    assert not flags[1]["above_threshold"] and flags[2]["above_threshold"]
    assert evaluation.calibration(df).first()["confidence_all"] == 0.9


def test_nan_becomes_null(mapped):
    assert mapped(["NaN", "0.5", None, "abc", ""], to_number(X)) == [None, 0.5, None, None, None]


def test_threshold_of_no_options(spark):
    df = scored(spark, [(1, True, 9.0, 0.0, False, False), (2, True, 9.0, None, False, False)])
    rows = {r["case_id"]: r for r in evaluation.passk_flags(df).collect()}
    assert math.isinf(rows[1]["confidence_threshold"]) and rows[2]["confidence_threshold"] is None
    assert not rows[1]["above_threshold"] and not rows[2]["above_threshold"]


def decided(spark, confidence, threshold, disease="Flu", **options):
    df = spark.createDataFrame(
        [(1, disease, confidence, threshold)],
        "case_id long, predicted_rank1_disease string, predicted_rank1_confidence double, threshold double",
    )
    return decision.decide(df, **options).first()


def test_confidence_equal_to_threshold(spark):
    assert decided(spark, 0.4, 0.4)["rank1_disease"] == "Flu"
    flags = evaluation.passk_flags(scored(spark, [(1, True, 0.4, 5.0, False, False)])).first()
    assert flags["fail_low_conf_not_referred"] and not flags["pass_at_1_success"]


def test_missing_confidence_in_the_layer(spark):
    row = decided(spark, None, 0.4, None)
    assert row["rank1_disease"] is None and row["rank1_confidence"] is None
    assert decided(spark, None, 0.4, None, missing="refer")["rank1_disease"] == fixed.REFER


def test_severe_is_referred_with_its_confidence(spark):
    row = decided(spark, 0.99, 0.4, "SLE")
    assert row["rank1_disease"] == fixed.REFER and row["rank1_confidence"] == 0.99
    assert len(fixed.SEVERE_DEFAULT) == 21 == decision.severe_table(spark).count()
    table = spark.createDataFrame([("Flu",)], "disease string")
    assert decided(spark, 0.99, 0.4, "Flu", severe=table)["rank1_disease"] == fixed.REFER
    assert decided(spark, 0.99, 0.4, "SLE", severe=table)["rank1_disease"] == "SLE"


def test_option_counts(mapped):
    values = ["1. A", None, "\n \n", "1. A\n\n 2. B. C \n3"]
    n = decision.count_options(X)
    assert mapped(values, n) == [1, 0, 0, 3]
    assert mapped(values, decision.dynamic_threshold(n)) == [2.0, 1.0, 1.0, 2 / 3]
    assert mapped(values[3:], decision.option_names(X)) == [["A", "B. C", "3"]]


def test_matching_either_way(spark):
    rows = [("", "Flu"), ("flu", "Influenza flu"), ("Flu B", "flu"), ("FLU", "flu"), (None, "Flu"), ("x", "Flu")]
    df = spark.createDataFrame(
        [(i, None, p, t) for i, (p, t) in enumerate(rows)],
        "i long, rank1_disease string, predicted_disease string, true_diagnosis string",
    )
    found = [(r["is_correct"], r["match_type"]) for r in responses.score_match(df).orderBy("i").collect()]
    assert found == [
        (True, "Partial"), (True, "Partial"), (True, "Partial"), (True, "Exact"), (False, None), (False, None),
    ]
    strict = responses.score_match(df, require_nonempty=True).orderBy("i").first()
    assert not strict["is_correct"]


def parsed(texts, *values):
    df = responses.parse_response(texts(values).withColumnRenamed("x", "raw_model_response"))
    return responses.flatten_top3(df).orderBy("i").collect()


def test_json_that_is_no_object(texts):
    row = parsed(texts, "[1]")[0]
    assert row["parse_ok"] and row["parse_error"] and row["predicted_disease"] == "[1]"
    assert row["model_confidence"] == 0.5 and row["parsed_model_json"] == "[1]"


JSON_TEXTS = [
    '{"a":1}', '{"a":1} x', "{'a':1}", '{"a":1,}', "1],[2", '{"a":1},"b":2', "null", "[1]", "5", '"x"', "", "01",
    '{"a":"x\ty"}', '{"a":1}\n', "[1,2]] ", "tru", "1}", '1},{"x":2', "1}]", '1,"v":2', '1}],[{"v":2', "[", "{}",
    '{"a":{"b":[1,2,{"c":null}]}}', '"}"', "1 2", "true", "-0.5", "+1", ".5", "5.", '{"a":1,"a":2}', '"a\\u00e9"',
    "NaN", '{"v":1},{"v":2', '"', "\\", '{"a":"\\"}"}', "[]]", "{}}",
]


def test_strict_json_agrees_with_python(mapped):
    def valid(text):
        try:
            json.loads(text)
            return True
        except ValueError:
            return False

    found = mapped(JSON_TEXTS, strict_json(X).isNotNull())
    assert {t: f for t, f in zip(JSON_TEXTS, found)} == {t: valid(t) for t in JSON_TEXTS}


def test_list_modes(mapped):
    values = ["['E_1', \"it's\"]", '["E_1"]', "nope", "[]", "['a'] zz", None]
    assert mapped(values, lists.parse_list(X, "json")) == [[], ["E_1"], [], [], [], []]
    assert mapped(values, lists.parse_list(X, "literal")) == [["E_1", "it's"], ["E_1"], None, [], None, None]
    assert mapped(values, lists.parse_list(X, "safe")) == [
        ["E_1", "it's"], ["E_1"], ["nope"], [], ["['a'] zz"], ["None"],
    ]
    assert mapped(values, lists.parse_error(lists.parse_list(X, "literal"), X)) == [
        None, None, "not a list", None, "not a list", None,
    ]
    with pytest.raises(ValueError):
        lists.parse_list(X, "other")


PRINTED = [
    "[('Flu', 0.4), ['Cold', 0.2], 'Gout', None, True, 7]", "[('Flu',), ()]", "('Flu', ['Cold', 1])", "['Flu',]", "[['Flu', 0.4],]",
    "[('Flu')]", "['a, (b', ('c]', 1)]", "['it\\'s', \"say \\\\ \\\"x\\\" \", '\\x41\\u00e9\\n\\q']", "[(1, 2), [None, 3], [['a'], 1]]",
    "[(]", "[)", "('Flu']", "[,]", "(,)", "['a' 'b']", "[1,,2]", "['a'] ['b']", "{'a': 1}", "[a]", "[01]", "[1.5, -2, +3, .5, 1e5]", "()", "[()]",
    " ['x', ('y',)]", "['x']\n", "[null, 'x']", "['\t', ('\xe9\U0001f600', 1)]", "('a', 'b'), ('c',)", "['unclosed", "5", "''", "[True, ]", "((('a'),),)",
]


def python_value(text):
    try:
        value = ast.literal_eval(text.lstrip(" \t"))
    except (ValueError, SyntaxError):
        return None
    return list(value) if isinstance(value, (list, tuple)) else None


# Python reads these; a joined string, and a tuple without its parentheses, stay unreadable here.
NOT_READ = {"['a' 'b']", "('a', 'b'), ('c',)"}


def test_printed_lists_agree_with_python(mapped):
    expected = {t: None if t in NOT_READ else python_value(t) for t in PRINTED}
    found = dict(zip(PRINTED, mapped(PRINTED, lists.parse_list(X, "literal"))))
    # lists in lists are printed only where they hold scalars
    flat = {t: v for t, v in expected.items() if not (v and any(isinstance(x, list) and any(isinstance(y, list) for y in x) for x in v))}
    same = {"+3": "3", ".5": "0.5", "1e5": "100000.0"}  # numbers keep their spelling
    assert {t: v and [same.get(x, x) for x in v] for t, v in found.items() if t in flat} == {t: v if v is None else [*map(str, v)] for t, v in flat.items()}

    def names(items):
        kept = [x[0] if isinstance(x, list) else x for x in items or [] if isinstance(x, str) or isinstance(x, list) and len(x) > 1]
        return [str(x) if not isinstance(x, list) else x for x in kept] + ["Flu"] * ("Flu" not in kept)

    truth = mapped(PRINTED, lists.differential_names(lists.differential_items(X, "literal"), F.lit("Flu")))
    nested = {t for t in PRINTED if t not in flat}
    assert {t: n for t, n in zip(PRINTED, truth) if t not in nested} == {t: names(v) for t, v in expected.items() if t not in nested}

    def clean(items):
        return [str(x[0]) if isinstance(x, (list, tuple)) and x else str(x) for x in items]

    cleaned = dict(zip(PRINTED, mapped(PRINTED, lists.clean_differential(X))))
    for t, v in expected.items():
        if t not in nested and t != "((('a'),),)":  # the first part is a tuple there
            assert [same.get(x, x) for x in cleaned[t]] == ([t] if v is None else clean(v)), t


def test_very_long_printed_lists(mapped):
    many = "[" + ", ".join(f"('a\\'{i}', {i})" for i in range(20_000)) + ", 'x' ]"
    quoted = "['" + "\\'" * 60_000 + "', (1,)]"
    assert mapped([many, quoted], F.size(lists.parse_list(X, "literal"))) == [20_001, 2]
    assert mapped([quoted], F.length(F.get(lists.parse_list(X, "literal"), F.lit(0)))) == [60_000]


def test_differentials(mapped):
    values = [
        "[['Flu', 0.4], ['Cold', 1]]", "['Flu','Cold']", "[['Flu'],'Cold']", "[[],'x']", "oops",
        "[['Flu', 0.4, 'more']]",
    ]
    names = lists.differential_names(lists.differential_items(X, "literal"), F.lit("Cold"))
    assert mapped(values, names) == [
        ["Flu", "Cold"], ["Flu", "Cold"], ["Cold"], ["x", "Cold"], ["Cold"], ["Flu", "Cold"],
    ]
    assert mapped(values, lists.clean_differential(X)) == [
        ["Flu", "Cold"], ["Flu", "Cold"], ["Flu", "Cold"], ["[]", "x"], ["oops"], ["Flu"],
    ]
    pairs = lists.parse_differential(F.replace(X, F.lit("'"), F.lit('"')))
    plain = F.transform(pairs, lambda p: F.concat_ws("=", p["disease"], p["probability"].cast("string")))
    assert mapped(values, plain) == [
        ["Flu=0.4", "Cold=1.0"], ["Flu", "Cold"], ["Flu", "Cold"], ["", "x"], [], ["Flu=0.4"],
    ]


def test_percentage_text_rounds_half_up(mapped):
    top = lists.top_differential(lists.parse_differential(X), 5, 1)
    text = F.transform(top, lambda p: p["probability_text"])
    assert mapped(['[["Flu", 0.0025], ["Cold", 0.5], ["x"]]'], text) == [["0.3%", "50.0%", None]]


def test_confidence_as_text(texts):
    row = parsed(texts, '{"final_prediction": {"disease": "Flu", "confidence": "0.6"}}')[0]
    assert (row["predicted_disease"], row["model_confidence"]) == ("Flu", 0.6)


def test_empty_final_falls_to_the_first_of_three(texts):
    top = '"top_3_predictions": [{"disease": "Flu", "confidence": 0.7}]'
    for text in ('{"final_prediction": {}, %s}' % top, '{"final_prediction": null, %s}' % top, "{%s}" % top):
        row = parsed(texts, text)[0]
        assert (row["predicted_disease"], row["model_confidence"]) == ("Flu", 0.7)
        assert (row["rank1_disease"], row["rank1_confidence"], row["rank2_disease"]) == ("Flu", 0.7, None)


def test_response_priorities(texts):
    long = "x" * 60
    rows = parsed(
        texts,
        '{"final_prediction": {"disease": null, "confidence": 0.7}}',
        '{"final_prediction": {"confidence": 0.7}}',
        '{"final_prediction": {"disease": "Flu", "reason": "none"}}',
        long + "\nmore",
        '{"other": 1}',
        '{"final_prediction": "Flu"}',
        '{"top_3_predictions": ["Flu"]}',
        '{"top_3_predictions": [{"confidence": 0.2}]}',
        None,
    )
    assert [r["predicted_disease"] for r in rows] == [
        None, '{"final_prediction": {"confidence": 0.7}}', "Flu", long[:50], '{"other": 1}',
        '{"final_prediction": "Flu"}', '{"top_3_predictions": ["Flu"]}',
        '{"top_3_predictions": [{"confidence": 0.2}]}', None,
    ]
    assert [r["model_confidence"] for r in rows] == [0.7, 0.7, 0.5, 0.5, 0.5, 0.5, 0.5, 0.2, None]
    assert [r["parse_ok"] for r in rows] == [True, True, True, False, True, True, True, True, False]
    assert [bool(r["parse_error"]) for r in rows] == [False, False, False, True, False, True, True, False, True]
    assert rows[2]["final_reason"] == "none"


def test_fences(mapped):
    values = ["a```json\n{1}\n```b", "```\nx\n``` ```y```", "no fence", "```json only", "``` a ```json b ```"]
    assert mapped(values, responses.strip_fence(X)) == ["\n{1}\n", "\nx\n", "no fence", " only", " b "]


def test_regex_needs_both(texts):
    values = [
        '"disease":   "Flu"', '"confidence": 0.5', '"disease":\t"Flu", "confidence": 0.5',
        '"disease": "Flu" "confidence": 0.1.2', '"disease": "", "confidence": 1', '"disease": "a\nb" "confidence": 1',
        '"disease": "A" "disease": "B" "confidence": 0.9 "confidence": 0.1', None,
    ]
    df = responses.extract_regex(texts(values), "x").orderBy("i").collect()
    assert [(r[2], r[3]) for r in df] == [
        (None, None), (None, None), ("Flu", 0.5), (None, None), ("", 1.0), (None, None), ("A", 0.9), (None, None),
    ]


def test_number_endings(mapped):
    values = ["1d", "1f", "1e3", " 2.5 ", "-.5", "0x1", "inf", "1.2.3"]
    assert mapped(values, to_number(X)) == [None, None, 1000.0, 2.5, -0.5, None, float("inf"), None]


def test_whitespace(mapped):
    values = ["a b\tc", "", "  ", " a b　", "\x1ca", None]
    assert mapped(values, word_count(X)) == [3, 0, 0, 2, 1, None]
    assert mapped(values, is_blank(X)) == [False, True, True, False, False, None]
    assert mapped(values, strip(X)) == ["a b\tc", "", "", "a b", "a", None]
    assert mapped([" a \nb", "x", ""], first_line(X)) == ["a", "x", ""]
    assert mapped(["a\n\n b \n\t\n"], line_count(X)) == [2]


def test_statistics_of_four_values(spark):
    df = spark.createDataFrame([("g", v) for v in (1, 2, 3, 10)], "g string, v long")
    row = profiling.numeric_stats(df, "v").first()
    assert (row["mean"], row["median"], row["min"], row["max"]) == (4.0, 2.5, 1, 10)
    box = profiling.box_summary(df, "v", ["g"]).first()
    assert (box["q1"], box["median"], box["q3"]) == (1.75, 2.5, 4.75)
    assert (box["whisker_low"], box["whisker_high"], box["outliers"]) == (1.0, 4.75, 1)
    words = spark.createDataFrame([("a " * n,) for n in (1, 2, 3, 10)], "t string")
    stats = profiling.length_stats(words, "t").where("measure = 'words'").first()
    assert stats["std"] == pytest.approx(3.5355339) and stats["total_length"] == 16


def test_ties_keep_first_seen_order(texts):
    counts = profiling.value_counts(texts(list("baabc")), "x", "i").collect()
    assert [(r["value"], r["n"]) for r in counts] == [("b", 2), ("a", 2), ("c", 1)]
    assert counts[0]["share_pct"] == 40.0 and counts[0]["distinct_values"] == 3


def test_completeness_counts_a_double_gap_twice(spark):
    df = spark.createDataFrame(
        [(None, None, None), ("a", "e", None), ("b", None, "[]")],
        "PATHOLOGY string, INITIAL_EVIDENCE string, EVIDENCES string",
    )
    row = profiling.completeness(df).first()
    assert (row["complete_reference"], row["complete_exact"], row["grade"]) == (1, 2, "GOOD")


def test_successes_overlap(spark):
    df = scored(spark, [(1, True, 0.9, 5.0, True, True)])
    row = evaluation.passk_summary(evaluation.passk_flags(df)).first()
    assert row["success_correct_dx"] == 1 and row["success_severe_referred"] == 1 and row["successes"] == 1


def test_true_marks(mapped, spark):
    assert mapped(["1", "1.0", "TRUE", " yes ", "✓", None], evaluation.truthy(X)) == [
        True, False, False, True, True, False,
    ]
    row = spark.createDataFrame([(True, 1.0, 1)], "b boolean, d double, n int").select(
        *[evaluation.truthy(F.col(c)) for c in "bdn"]
    ).first()
    assert list(row) == [True, False, True]


def test_fraction_of_small_groups(spark):
    sizes = {"a": 1, "b": 19, "c": 20, "d": 140}
    rows = [(g, i) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i long")
    picked = sampling.sample_fraction_per_group(df, "g", "i", 0.05).collect()
    assert sorted(map(tuple, picked)) == [("a", 0), ("b", 0), ("c", 0)] + [("d", i) for i in range(7)]
    stats = {r["g"]: r["selected"] for r in sampling.fraction_stats(df, "g", 0.05).collect()}
    assert stats == {"a": 1, "b": 1, "c": 1, "d": 7}


def code_table(spark):
    rows = [
        ("E_1", "cough", "Do you have a cough?", "B", None, None),
        ("E_2", "odd", "Have you?", "B", None, None),
        ("E_3", "pain", "Where is the pain?", "C", {"V_1": {"en": "arm"}, "V_2": {"en": "NA"}, "V_3": {}}, None),
        ("E_4", "empty", "", "B", None, None),
        ("E_5", None, None, "M", {"V_2": {"en": "leg"}}, None),
        ("E_6", "short", "Are you ill?", "B", None, None),
        ("E_7", "do", "Do you have you pain? Tell.", "M", {"V_1": {"en": "yes"}}, None),
        ("E_8", None, None, None, None, "plain text"),
    ]
    return spark.createDataFrame(
        rows,
        "code string, name string, question_en string, data_type string, "
        "value_meaning map<string,map<string,string>>, entry_text string",
    )


def test_symptoms(spark):
    cases = [
        (1, ["E_1", "E_2", "E_3_@_V_1", "E_3_@_V_2", "E_3_@_V_3", "E_3", "E_4", "E_9"]),
        (2, ["E_6", "E_4"]),
        (3, []),
        (4, ["E_3_@_V_1_@_x", "E_1_@_V_9", "E_7_@_V_1", "E_5_@_V_2"]),
        (5, ["E_9"] * 12 + ["E_1"]),
        (6, None),
    ]
    df = spark.createDataFrame(cases, "case_id long, codes array<string>")
    expected = {
        1: "a cough, have you, where is the pain: arm",
        2: fixed.DEFAULT_COMPLAINT,
        3: fixed.DEFAULT_COMPLAINT,
        4: "where is the pain: arm, a cough, pain: yes",
        5: fixed.DEFAULT_COMPLAINT,
        6: fixed.DEFAULT_COMPLAINT,
    }
    for limit in (1000, 0):  # broadcast, and the salted join beyond the size limit
        found = decoding.decode_symptoms(df, code_table(spark), max_rows=limit)
        assert {r["case_id"]: r["symptoms"] for r in found.collect()} == expected


def test_three_decoders(spark):
    df = spark.createDataFrame(
        [(1, "E_1"), (2, "E_5_@_V_2"), (3, "E_4"), (4, "E_8"), (5, "E_5"), (6, None)], "case_id long, c string"
    )
    for limit in (1000, 0):
        names = decoding.decode_name(df, code_table(spark), "c", "t", max_rows=limit).collect()
        asked = decoding.decode_question(df, code_table(spark), "c", "t", max_rows=limit).collect()
        assert {r["case_id"]: r["t"] for r in names} == {
            1: "cough", 2: "E_5_@_V_2", 3: "empty", 4: "plain text", 5: "E_5", 6: None,
        }
        assert {r["case_id"]: r["t"] for r in asked} == {
            1: "Do you have a cough?", 2: "E_5_@_V_2", 3: "", 4: "E_8", 5: "E_5", 6: None,
        }


def test_list_decoding_keeps_order(spark):
    df = spark.createDataFrame([(1, ["E_3", "E_1", "E_9", "E_1"]), (2, [])], "case_id long, codes array<string>")
    for limit in (1000, 0):
        rows = decoding.decode_list(df, code_table(spark), "codes", 3, "t", variant="name", max_rows=limit)
        found = {r["case_id"]: (r["t"], r["t_more"]) for r in rows.collect()}
        assert found == {1: (["pain", "cough", "E_9"], 1), 2: ([], 0)}


def test_lookup_tables(spark):
    names = {r["code"]: (r["name"], r["type"]) for r in decoding.evidence_lookup(code_table(spark), "name").collect()}
    assert names["E_5"] == ("", "M") and "E_8" not in names
    texts_ = {r["code"]: (r["symptom"], r["type"]) for r in decoding.evidence_lookup(code_table(spark), "symptom").collect()}
    assert texts_["E_4"] == ("", "B") and texts_["E_5"] == ("E_5", "M") and texts_["E_8"] == ("E_8", "unknown")


def test_severe_block_is_sorted(spark):
    table = decision.severe_table(spark, ["b", "A", "a", "é"])
    assert decoding.severe_block(table).first()[0] == "- A\n- a\n- b\n- é"


def case(spark, **cells):
    base = dict(
        case_id=1, split="test", AGE=50, SEX="M", INITIAL_EVIDENCE="E_1", EVIDENCES="['E_1', 'E_3_@_V_1']",
        DIFFERENTIAL_DIAGNOSIS="[['Flu', 0.4], ['Cold', 0.3]]", PATHOLOGY="Flu",
    )
    base.update(cells)
    return spark.createDataFrame(
        [tuple(base.values())],
        "case_id long, split string, AGE int, SEX string, INITIAL_EVIDENCE string, EVIDENCES string, "
        "DIFFERENTIAL_DIAGNOSIS string, PATHOLOGY string",
    )


def test_prompt(spark):
    prepared = records.prepare_cases(case(spark), code_table(spark))
    text = records.user_prompt(prepared).first()["user_prompt"]
    assert text == (
        "Patient Information:\n- Age: 50 years\n- Sex: Male\n- Symptoms: a cough, where is the pain: arm\n"
        "- Number of evidences: 2\n\ndiagnosis_options:\n1. Flu\n2. Cold\n\nBased on this patient's presentation, "
        "provide your diagnostic assessment with the top 3 most likely diagnoses and confidence scores."
    )


def test_prompt_with_rules(spark):
    names = ", ".join(f"'D{i}'" for i in range(7))
    prepared = records.prepare_cases(
        case(spark, DIFFERENTIAL_DIAGNOSIS=f"[{names}]", PATHOLOGY="D3"), code_table(spark)
    )
    text = records.user_prompt_rules(prepared, F.lit("- A\n- B")).first()["user_prompt"]
    assert "- confidence_threshold: 0.2857142857142857\n\nsevere_disease_list:\n- A\n- B\n\n\n\ndiagnosis_options:\n1. D0" in text


def test_unreadable_cells_in_a_prompt(spark):
    row = records.prepare_cases(
        case(spark, EVIDENCES="?", DIFFERENTIAL_DIAGNOSIS="?"), code_table(spark)
    ).first()
    assert row["evidence_error"] == "not a list" and row["num_evidences"] == 0
    assert (row["diagnosis_options"], row["confidence_threshold"]) == ("1. Flu", 1.0)
    single = records.prepare_cases(case(spark, DIFFERENTIAL_DIAGNOSIS="[]"), code_table(spark)).first()
    assert (single["diagnosis_options"], single["confidence_threshold"]) == ("1. Flu", 2.0)


def test_question_record(spark):
    codes = json.dumps(["E_1"] * 9 + ["E_3_@_V_1"] + ["E_1"] * 8)
    df = case(spark, EVIDENCES=codes, DIFFERENTIAL_DIAGNOSIS='[["Flu", 0.4], "Cold", ["X", 1], ["Y", 1]]')
    row = records.training_record_a(df, code_table(spark)).first()
    told = ", ".join(["Do you have a cough?"] * 9 + ["E_3_@_V_1"])
    assert row["instruction"] == (
        f"A 50-year-old M patient presents with the following:\n\nSymptoms: {told}, and 5 other symptoms\n\n"
        "What is the most likely diagnosis?"
    )
    assert row["output"] == "Flu\n\nDifferential diagnosis to consider: Flu, X" and row["input"] == ""
    assert row["metadata"].asDict() == {"age": 50, "sex": "M", "pathology": "Flu"}
    bad = records.training_record_a(case(spark), code_table(spark)).first()  # single quotes are no JSON
    assert bad["output"] == "Flu" and "Symptoms: \n" in bad["instruction"]


def test_label_record_and_messages(spark):
    df = records.training_record_b(case(spark, PATHOLOGY=" Flu ", AGE=None))
    row = df.first()
    assert row["input"] == (
        "Patient:\n- Age: Unknown\n- Sex: M\n- Initial evidence: E_1\n- Evidences: E_1, E_3_@_V_1\n"
        "- Possible diagnoses: Flu, Cold"
    )
    assert row["output"] == "Flu" and row["instruction"] == fixed.LABEL_RECORD_INSTRUCTION
    chat = records.to_messages(df, {"system": F.col("instruction"), "assistant": F.col("output")}).first()
    assert [tuple(m) for m in chat["messages"]] == [("system", fixed.LABEL_RECORD_INSTRUCTION), ("assistant", "Flu")]
    assert spark.range(1).select(records.system_prompt()).first()[0].endswith('"confidence": 0.6\n  }\n}\n')


def test_evidence_columns(spark):
    df = spark.createDataFrame([(1, "a", ["x", "y"]), (2, None, None)], "i long, s string, l array<string>")
    rows = df.select(lists.normalise_evidence(df, "s"), lists.normalise_evidence(df, "l")).collect()
    assert [tuple(r) for r in rows] == [(["a"], ["x", "y"]), ([], [])]
    counts = profiling.evidence_counts(df, "l", "i").collect()
    assert [(r["value"], r["n"]) for r in counts] == [("x", 1), ("y", 1)]
    assert profiling.evidence_counts(df, "s", "i", n=1).count() == 1


def test_bands(spark):
    df = spark.createDataFrame([("w " * n,) for n in (49, 50, 99, 100)], "t string")
    rows = {r["band"]: r["n"] for r in profiling.length_bands(df, "t").collect()}
    assert rows == {"short": 1, "medium": 2, "long": 1}


def test_terms_inside_words(texts):
    rows = profiling.term_counts(texts(["Cells cell", "aaa"]), "x", ("cell", "cells", "aa")).collect()
    assert [(r["term"], r["n"], r["per_document"]) for r in rows] == [
        ("cell", 2, 1.0), ("cells", 1, 0.5), ("aa", 1, 0.5),
    ]
    first = profiling.term_counts(texts(["cell", "cell"]), "x", ("cell",), n=1, order_key="i").first()
    assert first["n"] == 1


def test_corpus_quality(texts):
    df = texts(["Disease " * 120, "patient", " "])
    row = profiling.corpus_quality(df, "x").first()
    assert (row["documents"], row["empty"], row["very_short"], row["with_terms"]) == (3, 1, 2, 2)
    assert row["grade"] == "GOOD"
    assert profiling.corpus_quality(df, "x", n=1, order_key="i").first()["with_terms_pct"] == 100.0


def test_histogram_bins(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.99, 2.0, 10.0)], "v double")
    assert [r["n"] for r in profiling.histogram(df, "v", 5).orderBy("bin").collect()] == [2, 1, 0, 0, 1]
    flat = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    rows = profiling.histogram(flat, "v", 2).orderBy("bin").collect()
    assert [(r["bin_start"], r["n"]) for r in rows] == [(2.5, 0), (3.0, 2)]


def qa_table(spark):
    four = {"A": "1", "B": "2", "C": "3", "D": "4"}
    rows = [
        (1, "train", "q one two", four, "A"), (2, "train", "q one two", four, "B"), (3, "train", None, four, "E"),
        (4, "test", " ", {"A": "1"}, None), (5, "test", None, four, "D"),
    ]
    return spark.createDataFrame(
        rows, "qa_id long, split string, question string, options map<string,string>, answer_idx string"
    )


def test_question_checks(spark):
    qa = qa_table(spark)
    checks = {r["check"]: r["passed"] for r in profiling.qa_checklist(qa).collect()}
    assert checks == dict.fromkeys(
        ("required_splits", "splits_not_empty", "required_fields", "four_options", "all"), True
    )
    lacking = {r["check"]: r["passed"] for r in profiling.qa_checklist(qa.drop("answer_idx").where("split = 'test'")).collect()}
    assert not any(lacking.values())
    rows = {r["split"]: r for r in profiling.qa_quality(qa).collect()}
    assert rows["train"]["duplicate_questions"] == 1 and rows["train"]["invalid_answers"] == 1
    assert rows["test"]["missing_questions"] == 2 and rows["test"]["incomplete_options"] == 1
    assert not rows["train"]["passed"]
    info = profiling.dataset_info(qa, "here").first()
    assert info["splits"] == {"train": 3, "test": 2} and info["sample_question_length"] == 3
    assert info["fields"] == ["qa_id", "question", "options", "answer_idx"]
    options = decoding.explode_options(qa).where("is_answer").collect()
    assert sorted((r["qa_id"], r["option_text"]) for r in options) == [(1, "1"), (2, "2"), (5, "4")]


def test_field_profile(spark):
    df = spark.createDataFrame(
        [(2, ["a"], {"k": "v"}, 1.5), (1, ["a", "b"], {"x": "1", "y": "2", "z": "3", "w": "4"}, 2.5)],
        "i long, l array<string>, m map<string,string>, d double",
    )
    rows = {r["field"]: (r["type"], r["length"], r["keys"] and len(r["keys"].split(", "))) for r in profiling.field_profile(df, "i").collect()}
    assert rows == {"i": ("int", None, None), "l": ("list", 2, None), "m": ("dict", None, 3), "d": ("float", None, None)}


def test_empty_run(spark):
    none = scored(spark, []).withColumn("refer_reason", F.lit("x"))
    summary = evaluation.assert_partition(evaluation.passk_summary(evaluation.passk_flags(none)), fail=True)
    row = summary.first()
    assert row["total"] == 0 and row["pass_at_1"] == 0.0 and row["partition_ok"]
    assert evaluation.decision_breakdown(none).count() == 0
    assert evaluation.refer_reasons(none).count() == 0
    assert evaluation.safety_check(none).first()["safety"] == "check"
    assert evaluation.calibration(none).first()["calibration"] == "poor"


def test_partition_mismatch_is_an_error(spark):
    wrong = spark.createDataFrame(
        [(3, 1, 1, 0, 0)],
        "total long, successes long, fail_wrong_dx long, fail_severe_not_referred long, fail_low_conf_not_referred long",
    )
    assert not evaluation.assert_partition(wrong).first()["partition_ok"]
    with pytest.raises(Exception, match="do not add up"):
        evaluation.assert_partition(wrong, fail=True).collect()


def test_refer_reasons_without_the_column(spark):
    df = scored(spark, [(1, True, 0.4, 5.0, True, False)])
    assert evaluation.refer_reasons(df).count() == 0


def test_compare_phases(spark):
    a = scored(spark, [(1, True, 0.9, 5.0, False, False)])
    b = scored(spark, [(1, False, 0.9, 5.0, False, False), (2, True, 0.1, 5.0, True, False)])
    rows = {r["phase"]: (r["total"], r["pass_at_1"]) for r in evaluation.compare_phases({"1a": a, "3": b}).collect()}
    assert rows == {"1a": (1, 100.0), "3": (2, 50.0)}


def test_per_class_scores(spark):
    df = spark.createDataFrame(
        [("a", "a"), ("a", "b"), ("b", "b"), ("c", None)], "true_diagnosis string, rank1_disease string"
    )
    rows = {r["label"]: (r["precision"], r["recall"], r["f1"]) for r in evaluation.prf(df).collect()}
    assert rows == {"a": (1.0, 0.5, 2 / 3), "b": (0.5, 1.0, 2 / 3), "c": (0.0, 0.0, 0.0)}
    averages = evaluation.prf_averages(evaluation.prf(df)).first()
    assert averages["micro_precision"] == 2 / 3 and averages["micro_recall"] == 0.5
    labels = evaluation.label_accuracy(df, "true_diagnosis", "rank1_disease").first()
    assert (labels["cases"], labels["correct"], labels["accuracy"]) == (4, 2, 0.5)
