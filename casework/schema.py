"""Fixed input and output schemas."""

from pyspark.sql import types as T

_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(*fields):
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


CASES = _struct(
    ("case_id", _L), ("AGE", _I), ("SEX", _S), ("INITIAL_EVIDENCE", _S), ("EVIDENCES", _S),
    ("DIFFERENTIAL_DIAGNOSIS", _S), ("PATHOLOGY", _S),
)

CODE_ENTRY = _struct(
    ("name", _S), ("question_en", _S), ("data_type", _S),
    ("value_meaning", T.MapType(_S, T.MapType(_S, _S))),
)

QA = _struct(
    ("qa_id", _L), ("question", _S), ("options", T.MapType(_S, _S)), ("answer_idx", _S),
)

RESULTS = _struct(
    ("case_num", _L), ("original_test_index", _L), ("age", _I), ("sex", _S), ("symptoms", _S),
    ("num_evidences", _I), ("raw_evidences", _S), ("raw_differential_diagnosis", _S),
    ("true_diagnosis", _S), ("diagnosis_options", _S), ("num_diagnosis_options", _I),
    ("confidence_threshold", _D), ("severe_disease_list", _S),
    ("rank1_disease", _S), ("rank1_confidence", _D), ("rank2_disease", _S),
    ("rank2_confidence", _D), ("rank3_disease", _S), ("rank3_confidence", _D),
    ("final_prediction", _S), ("final_confidence", _D), ("final_reason", _S),
    ("final_is_referral", _B), ("diagnosis_for_accuracy", _S), ("diagnostic_correct", _S),
    ("correct", _S), ("parse_ok", _B), ("parse_error", _S), ("raw_model_response", _S),
    ("parsed_model_json", _S),
)

# A decided run before its types are repaired; marks and numbers may be text.
SCORED = _struct(
    ("case_id", _L), ("correct", _S), ("confidence", _S), ("num_options", _S), ("action", _S),
    ("is_severe", _S), ("high_confidence", _S), ("refer_reason", _S),
)
