"""For each query the same result in SQL over the given tables, written on its own.

The SQL works on the lists behind the case texts and never reads what an operator has parsed.
"""

from casework import fixed_values as fixed

# The whitespace class spelled out, as the regex engine's own class is ASCII only.
WS = "\\t\\n\\x0b\\x0c\\r\\x1c-\\x20\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


def words(column: str) -> str:
    return f"len(regexp_extract_all({column}, '[^{WS}]+'))"


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


NATION = "'NATION_' || ((k * 3 + c + {} * 7) % 25)"

CASES = f"""
keys AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders),
parts AS (
  SELECT k, c,
    list_transform(range(1, k % 23 + 1), lambda i: [i, (k * 7 + c * i) % 2200]) AS pairs,
    list_transform(range(1, (k + c) % 6 + 1), lambda j: {NATION.format('j')}) AS dx0,
    list_transform(range(1, (k + c) % 6 + 1), lambda j: '0.' || (40 - j * 6)) AS px0,
    k % 43 <> 42 AS ev_ok, k % 41 <> 40 AS dx_ok,
    CASE WHEN k % 3 = 0 THEN 'NATION_' || (c % 25) ELSE {NATION.format(1)} END AS truth
  FROM keys
),
cases AS (
  SELECT k AS case_id, k, c, ev_ok, dx_ok, truth, k % 90 AS age,
    CASE WHEN k % 10 = 0 THEN 'test' WHEN k % 10 = 1 THEN 'validate' ELSE 'train' END AS split,
    CASE WHEN c % 2 = 0 THEN 'M' ELSE 'F' END AS sex,
    CASE WHEN k % 23 > 0 THEN 'E_' || ((k * 7 + c) % 2200) END AS initial,
    CASE WHEN ev_ok THEN list_transform(pairs, lambda p: 'E_' || p[2] ||
      CASE WHEN (p[2] + p[1]) % 3 = 0 THEN '' ELSE '_@_V_' || ((p[2] + p[1]) % 7 + 1) END) ELSE [] END AS ev,
    CASE WHEN dx_ok THEN dx0 ELSE [] END AS dx,
    CASE WHEN dx_ok THEN px0 ELSE [] END AS px,
    CASE WHEN NOT dx_ok THEN [truth] WHEN list_contains(dx0, truth) THEN dx0
      ELSE list_append(dx0, truth) END AS names
  FROM parts
)"""

EV_TEXT = (
    "CASE WHEN ev_ok THEN '[' || array_to_string(list_transform(ev, lambda x: {q} || x || {q}), ', ') || ']' "
    "ELSE 'n/a' END"
)
DX_TEXT = (
    "CASE WHEN dx_ok THEN '[' || array_to_string(list_transform(range(1, len(dx) + 1), "
    "lambda n: '[' || {q} || dx[n] || {q} || ', ' || px[n] || ']'), ', ') || ']' ELSE 'not a list' END"
)
ONE, TWO = "chr(39)", "chr(34)"

# The items behind the printed lists: what kind each is, and its name.
PRINTED = f"""
printed AS (
  SELECT o_orderkey AS k, o_orderkey % 43 <> 42 AS ev_ok, o_orderkey % 41 <> 40 AS dx_ok,
    list_transform(range(1, k % 7 + 1), lambda i: CASE WHEN (k + i) % 4 = 0 THEN 'True' ELSE 'E_' || ((k * 7 + o_custkey * i) % 2200) END) AS ev,
    list_transform(range(1, (k + o_custkey) % 8 + 1),
      lambda j: {{'kind': (o_custkey + j) % 5, 'name': 'NATION_' || ((k * 3 + o_custkey + j * 7) % 25)}}) AS dx,
    CASE WHEN k % 3 = 0 THEN 'NATION_' || (o_custkey % 25) ELSE 'NATION_' || ((k * 3 + o_custkey + 7) % 25) END AS truth
  FROM orders
)"""

GAPS = f"""{CASES},
gaps AS (
  SELECT case_id, CASE WHEN k % 19 <> 0 THEN truth END AS truth,
    CASE WHEN k % 17 = 0 THEN '' WHEN k % 17 <> 1 THEN sex END AS sex,
    CASE WHEN k % 29 <> 0 THEN age END AS age, initial,
    CASE WHEN k % 23 <> 0 THEN {EV_TEXT.format(q=ONE)} END AS evidences
  FROM cases
)"""

OPTIONS = (
    "array_to_string(list_transform(range(1, len(names) + 1), lambda n: n || '. ' || names[n]), chr(10))"
)

CODES = """
codes AS (
  SELECT 'E_' || p_partkey AS code, p_partkey % 13 = 0 AS plain, p_name, p_brand,
    CASE WHEN p_partkey % 13 <> 0 AND p_partkey % 5 <> 4 THEN p_name END AS name,
    CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN ''
      WHEN p_partkey % 7 <> 3 THEN 'Do you have ' || p_name || '?' END AS question,
    CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_type IN ('STANDARD', 'ECONOMY') THEN 'B'
      WHEN p_type IN ('MEDIUM', 'PROMO') THEN 'C' ELSE 'M' END AS kind
  FROM part
)"""

# One row per listed code of a case, in order, with what the code says.
SAID = """
listed AS (
  SELECT case_id, n AS pos, ev[n] AS code, split_part(ev[n], '_@_', 1) AS base,
    split_part(ev[n], '_@_', 2) AS value
  FROM (SELECT case_id, ev, unnest(range(1, len(ev) + 1)) AS n FROM cases)
),
said AS (
  SELECT case_id, pos,
    CASE WHEN question = '' OR question IS NULL THEN NULL
      WHEN kind = 'B' THEN CASE WHEN length(p_name) > 5 THEN lower(p_name) END
      WHEN value IN ('V_1', 'V_2', 'V_3', 'V_5')
        THEN 'have ' || lower(p_name) || ': ' || p_brand || '-' || substr(value, 3) END AS text
  FROM listed JOIN codes ON base = codes.code
  WHERE pos <= 12
),
symptoms AS (
  SELECT cases.case_id, coalesce(string_agg(text, ', ' ORDER BY pos), 'patient presents with medical complaint')
    AS symptoms
  FROM cases LEFT JOIN said ON cases.case_id = said.case_id AND text IS NOT NULL
  GROUP BY cases.case_id
),
asked AS (
  SELECT cases.*, symptoms, len(ev) AS num_evidences, CASE WHEN sex = 'M' THEN 'Male' ELSE 'Female' END AS sex_text,
    CASE WHEN dx_ok THEN 2 / len(names) ELSE 1 END AS threshold
  FROM cases JOIN symptoms USING (case_id)
)"""

SEVERE = "severe AS (SELECT n_name AS disease FROM nation WHERE n_regionkey = 0)"
SEVERE_TEXT = "(SELECT string_agg('- ' || disease, chr(10) ORDER BY disease) FROM severe)"


def hundredths(n: str) -> str:
    return f"({n} // 100) || '.' || lpad(cast({n} % 100 AS varchar), 2, '0')"


RESPONSES = f"""{CASES},
sure AS (
  SELECT *, (k * 37) % 101 AS s1, (k * 37) % 101 // 2 AS s2, (k * 37) % 101 // 4 AS s3, k % 11 AS form,
    {NATION.format(1)} AS n1, {NATION.format(2)} AS n2, {NATION.format(3)} AS n3,
    CASE WHEN (k * 3 + c + 7) % 25 % 5 = 0 THEN 'severity'
      WHEN (k * 37) % 101 < 40 THEN 'low_confidence' ELSE 'none' END AS reason
  FROM cases
),
top AS (
  SELECT *, CASE WHEN reason = 'none' THEN n1 ELSE '{fixed.REFER}' END AS final,
    '{{"top_3_predictions": [{{"rank": 1, "disease": "' || n1 || '", "confidence": ' || {hundredths('s1')} ||
    '}}, {{"rank": 2, "disease": "' || n2 || '", "confidence": ' || {hundredths('s2')} ||
    '}}, {{"rank": 3, "disease": "' || n3 || '", "confidence": ' || {hundredths('s3')} || '}}]' AS head
  FROM sure
),
wholes AS (
  SELECT *, head || ', "final_prediction": {{' || CASE WHEN k % 3 = 0 THEN '"disease": "said first", ' ELSE '' END ||
    '"disease": "' || final || '", "reason": "' || reason ||
    '", "confidence": ' || CASE WHEN k % 2 = 0 THEN {hundredths('s1')} ELSE '"' || {hundredths('s1')} || '"' END
    || '}}}}' AS whole
  FROM top
),
responses AS (
  SELECT *, CASE form
    WHEN 0 THEN whole
    WHEN 1 THEN 'Here it is:' || chr(10) || '```json' || chr(10) || whole || chr(10) || '```' || chr(10) || 'Take care.'
    WHEN 2 THEN '```' || chr(10) || whole || chr(10) || '```'
    WHEN 3 THEN CASE WHEN k % 2 = 0 THEN chr(10) ELSE '' END || 'I think it is ' || n1 || '.' || chr(10) || 'Please see a doctor.'
    WHEN 4 THEN head || '}}'
    WHEN 5 THEN whole || ' That is all.'
    WHEN 7 THEN '{{''final_prediction'': {{''disease'': ''' || n1 || '''}}}}'
    WHEN 8 THEN '[1, 2]'
    WHEN 9 THEN head || ', "final_prediction": {{}}}}'
    WHEN 10 THEN head || ', "final_prediction": {{"disease": null, "confidence": 0.7}}}}'
    END AS raw
  FROM wholes
)"""

# What the eleven forms mean: which are objects, which carry a top three, and what is predicted.
PARSED = f"""{RESPONSES},
parsed AS (
  SELECT *, form IN (0, 1, 2, 4, 9, 10) AS is_object,
    CASE WHEN form IN (0, 1, 2) THEN final WHEN form IN (4, 9) THEN n1
      WHEN form IN (3, 5, 7, 8) THEN substr(split_part(ltrim(raw, chr(10)), chr(10), 1), 1, 50) END AS predicted,
    CASE WHEN form IN (0, 1, 2, 4, 9) THEN s1 / 100 WHEN form = 10 THEN 0.7::double
      WHEN form IN (3, 5, 7, 8) THEN 0.5::double END AS confidence,
    CASE WHEN form IN (0, 1, 2) THEN reason END AS final_reason
  FROM responses
),
judged AS (
  SELECT *, CASE WHEN is_object THEN n1 END AS rank1,
    CASE WHEN is_object THEN n1 ELSE predicted END AS judged
  FROM parsed
),
marked AS (
  SELECT *, coalesce(contains(lower(judged), lower(truth)) OR contains(lower(truth), lower(judged)), false)
    AS is_correct
  FROM judged
)"""

# The decision layer: the first disease and the first unquoted confidence in the raw text.
DECIDED = f"""{RESPONSES}, {SEVERE},
extracted AS (
  SELECT *, 2 / len(names) AS threshold,
    CASE WHEN regexp_matches(raw, '"disease": *"[^"]*"') AND regexp_matches(raw, '"confidence": *[0-9.]')
      THEN regexp_extract(raw, '"disease": *"([^"]*)"', 1) END AS disease,
    CASE WHEN regexp_matches(raw, '"disease": *"[^"]*"') AND regexp_matches(raw, '"confidence": *[0-9.]')
      THEN cast(regexp_extract(raw, '"confidence": *([0-9.]+)', 1) AS double) END AS confidence
  FROM responses
),
decided AS (
  SELECT *, coalesce(disease IN (SELECT disease FROM severe), false) AS is_severe,
    coalesce(confidence < threshold, false) AS low,
    coalesce(contains(lower(disease), lower(truth)) OR contains(lower(truth), lower(disease)), false) AS correct
  FROM extracted
),
flags AS (
  SELECT *, is_severe OR low AS referred, coalesce(confidence > threshold, false) AS above FROM decided
)"""

OUTCOMES = """
  count(*) AS total,
  count(*) FILTER (passed) AS successes,
  count(*) FILTER (above AND correct AND NOT (is_severe AND NOT referred)) AS success_correct_dx,
  count(*) FILTER (is_severe AND referred) AS success_severe_referred,
  count(*) FILTER (NOT above AND referred) AS success_low_conf_referred,
  count(*) FILTER (NOT passed) AS failures,
  count(*) FILTER (NOT passed AND NOT (is_severe AND NOT referred) AND (above OR referred)) AS fail_wrong_dx,
  count(*) FILTER (is_severe AND NOT referred) AS fail_severe_not_referred,
  count(*) FILTER (NOT above AND NOT referred AND NOT is_severe) AS fail_low_conf_not_referred,
  count(*) FILTER (passed) / count(*) * 100 AS pass_at_1,
  count(*) FILTER (NOT passed) / count(*) * 100 AS failure_pct"""
PASSED = """
passing AS (
  SELECT *, (above AND correct AND NOT (is_severe AND NOT referred)) OR (is_severe AND referred)
    OR (NOT above AND referred) AS passed
  FROM flags
)"""

QA = """
qa AS (
  SELECT doc_id AS qa_id, CASE WHEN doc_id % 9 = 0 THEN 'test' ELSE 'train' END AS split,
    CASE WHEN doc_id % 31 <> 30 THEN text END AS question, source, doc_id % 17 <> 0 AS has_four,
    CASE WHEN doc_id % 37 <> 36 THEN substr('ABCDE', doc_id % 5 + 1, 1) END AS answer_idx
  FROM documents
)"""

CORPUS = """
corpus AS (
  SELECT doc_id, 'data/' || source || '/' || doc_id || '.txt' AS path, source AS category, lang, text
  FROM documents
)"""

SCORED = """
scored AS (
  SELECT doc_id AS case_id, doc_id % 9 IN (0, 2, 3, 4, 5) AS correct,
    CASE WHEN doc_id % 23 = 4 THEN 'infinity'::double WHEN doc_id % 23 < 4 THEN NULL
      ELSE ((doc_id * 13) % 100) / 100 END AS confidence,
    CASE WHEN doc_id % 7 <> 6 THEN (doc_id % 6)::double END AS num_options,
    quality = 1 AS is_referral, toxic = 1 AS is_severe, doc_id % 2 = 0 AS high_confidence
  FROM labels
)"""


def bands(source: str, by: str, cuts: tuple, labels: tuple) -> str:
    arms = " ".join(f"WHEN w < {cut} THEN {literal(label)}" for cut, label in zip(cuts, labels))
    keys, group = (f"{by}, ", f"{by}, ") if by else ("", "")
    names = "[" + ", ".join(literal(label) for label in labels) + "]"
    return f"""
sized AS (SELECT {keys}CASE {arms} ELSE {literal(labels[-1])} END AS band FROM {source}),
totals AS (SELECT {keys}count(*) AS total, list(band) AS all_bands FROM sized {'GROUP BY ' + by if by else ''}),
wide AS (SELECT {keys}total, all_bands, unnest({names}) AS band FROM totals)
SELECT {keys}band, len(list_filter(all_bands, lambda b: b = band)) AS n,
  len(list_filter(all_bands, lambda b: b = band)) / total * 100 AS share_pct
FROM wide"""


HASH = "md5('42|' || case_id)"


def prompt(template: str, **values: str) -> str:
    """A fixed text as SQL with its fields replaced by expressions."""
    text = literal(template)
    for name, expression in values.items():
        text = text.replace("{" + name + "}", f"' || ({expression}) || '")
    return text


CASE_FIELDS = {
    "age": "age", "sex": "sex_text", "symptoms": "symptoms", "num_evidences": "num_evidences",
    "options": OPTIONS,
}
CODE_TEXT = "coalesce(question, name, codes.code, listed.code)"
LABEL_INPUT = prompt(
    fixed.LABEL_RECORD_INPUT,
    age="age",
    sex="sex",
    initial="coalesce(initial, 'Unknown')",
    evidences="CASE WHEN ev_ok THEN array_to_string(ev[1:20], ', ') ELSE 'n/a' END",
    differential="CASE WHEN dx_ok THEN array_to_string(dx[1:8], ', ') ELSE 'not a list' END",
)

RESULTS = f"""SELECT case_num, case_id AS original_test_index, s.age, sex_text AS sex, symptoms, num_evidences,
  s.truth AS true_diagnosis, {OPTIONS.replace('names', 's.names')} AS diagnosis_options,
  len(s.names) AS num_diagnosis_options, threshold::double AS confidence_threshold,
  {SEVERE_TEXT} AS severe_disease_list,
  rank1 AS rank1_disease, CASE WHEN is_object THEN s1 / 100 END AS rank1_confidence,
  CASE WHEN is_object THEN n2 END AS rank2_disease, CASE WHEN is_object THEN s2 / 100 END AS rank2_confidence,
  CASE WHEN is_object THEN n3 END AS rank3_disease, CASE WHEN is_object THEN s3 / 100 END AS rank3_confidence,
  predicted AS final_prediction, confidence AS final_confidence, final_reason,
  coalesce(predicted = '{fixed.REFER}', false) AS final_is_referral, judged AS diagnosis_for_accuracy,
  CASE WHEN is_correct THEN '✓' ELSE '✗' END AS diagnostic_correct,
  CASE WHEN is_correct THEN '✓' ELSE '✗' END AS correct,
  form IN (0, 1, 2, 4, 8, 9, 10) AS parse_ok,
  CASE WHEN form = 8 THEN 'not the expected JSON object' WHEN form IN (3, 5, 6, 7) THEN 'not valid JSON' END
    AS parse_error
FROM sampled s JOIN asked USING (case_id)"""

# Sums over blocks of 50 case numbers; the last block may be unfinished.
RUNNING = """
blocks AS (
  SELECT case_id // 50 AS block, count(*) AS n, count(*) FILTER (is_correct) AS r FROM marked WHERE {} GROUP BY 1),
running AS (
  SELECT cast(sum(n) OVER (ORDER BY block) AS bigint) AS cases, cast(sum(r) OVER (ORDER BY block) AS bigint) AS correct
  FROM blocks)
SELECT cases, correct, correct / cases * 100 AS accuracy FROM running"""

ORACLES: dict[str, str] = {
    "s1_load_cases": f"""WITH {CASES}
SELECT case_id, split, age AS "AGE", sex AS "SEX", initial AS "INITIAL_EVIDENCE",
  {EV_TEXT.format(q=ONE)} AS "EVIDENCES", {EV_TEXT.format(q=TWO)} AS "EVIDENCES_JSON",
  {DX_TEXT.format(q=ONE)} AS "DIFFERENTIAL_DIAGNOSIS", {DX_TEXT.format(q=TWO)} AS "DIFFERENTIAL_JSON",
  truth AS "PATHOLOGY"
FROM cases""",
    "s1_load_cases_by_position": """
SELECT o_orderkey AS case_id, o_custkey, year(o_orderdate) AS year, 'all' AS split FROM orders""",
    "s3_load_qa_by_position": """
SELECT doc_id AS qa_id, lang, n_chars, 'all' AS split FROM documents""",
    "s4_catalog_rows": """
SELECT cast(n_regionkey AS varchar) AS category,
  cast(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_regionkey || '/' || n_name) - 1 AS integer) AS pos,
  n_regionkey || '/' || n_name AS path
FROM nation""",
    "p1_sample_n": f"""WITH {CASES}
SELECT case_id, split, truth AS "PATHOLOGY", row_number() OVER (ORDER BY {HASH}, case_id) AS case_num
FROM cases QUALIFY case_num <= 1000""",
    "p2_shuffle_take": f"""WITH {CASES}
SELECT case_id, split, truth AS "PATHOLOGY",
  row_number() OVER (PARTITION BY split ORDER BY {HASH}, case_id) AS position
FROM cases WHERE split <> 'test'
QUALIFY position <= CASE WHEN split = 'train' THEN 5000 ELSE 500 END""",
    "p3_take_first": f"""WITH {CASES}
SELECT case_id, {EV_TEXT.format(q=ONE)} AS "EVIDENCES" FROM cases ORDER BY case_id LIMIT 1000""",
    "p3_take_positions": f"""WITH {CASES}
SELECT case_id, truth AS "PATHOLOGY", row_number() OVER (ORDER BY case_id) - 1 AS position
FROM cases QUALIFY position IN (0, 100, 500, 1000, 10000, 50000, 100000)""",
    "p4a_sample_fraction_per_group": f"""WITH {CORPUS}
SELECT lang, doc_id, path FROM corpus
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id)
  <= greatest(1, floor(count(*) OVER (PARTITION BY lang) * 0.05::double))""",
    "p4a_fraction_stats": f"""WITH {CORPUS},
sizes AS (SELECT category, count(*) AS total FROM corpus GROUP BY category)
SELECT category, total, cast(greatest(1, floor(total * 0.05::double)) AS bigint) AS selected,
  greatest(1, floor(total * 0.05::double)) / total * 100 AS selected_pct
FROM sizes""",
    "p4b_top_n_per_group": f"""WITH {CORPUS}
SELECT category, doc_id, path FROM corpus
QUALIFY row_number() OVER (PARTITION BY category ORDER BY doc_id) <= 3""",
    "p4c_filter_groups": f"""WITH {CORPUS}
SELECT category, path FROM corpus WHERE category IN ('src1', 'src2')""",
    "p5_quantile_exemplars": f"""WITH ranked AS (
  SELECT doc_id, {words('text')} AS words, row_number() OVER (ORDER BY {words('text')}, doc_id) - 1 AS place,
    count(*) OVER () AS size
  FROM documents)
SELECT doc_id, words, CASE place WHEN size // 4 THEN 'short' WHEN size // 2 THEN 'medium' ELSE 'long' END AS exemplar
FROM ranked WHERE place IN (size // 4, size // 2, 3 * size // 4)""",
    "d1_parse_list_json": f"""WITH {CASES}
SELECT case_id, len(ev) AS n, array_to_string(ev, '|') AS codes FROM cases""",
    "d2_parse_list_literal": f"""WITH {CASES}
SELECT case_id, CASE WHEN ev_ok THEN len(ev) END AS n, CASE WHEN ev_ok THEN array_to_string(ev, '|') END AS codes,
  CASE WHEN NOT ev_ok THEN 'not a list' END AS parse_error
FROM cases""",
    "d3_parse_list_safe": f"""WITH {CASES}
SELECT case_id, CASE WHEN ev_ok THEN array_to_string(ev, '|') ELSE 'n/a' END AS codes FROM cases""",
    "d4a_parse_differential": f"""WITH {CASES}
SELECT case_id, n - 1 AS pos, dx[n] AS disease, cast(px[n] AS double) AS probability
FROM (SELECT *, unnest(range(1, len(dx) + 1)) AS n FROM cases)""",
    "d4b_differential_names": f"""WITH {CASES}
SELECT case_id, array_to_string(names, '|') AS names, len(names) AS num_options, {OPTIONS} AS diagnosis_options,
  CASE WHEN dx_ok THEN 2 / len(names) ELSE 1 END::double AS confidence_threshold
FROM cases""",
    "d4c_top_differential": f"""WITH {CASES}
SELECT case_id, n - 1 AS pos, dx[n] AS disease, substr(px[n], 3) || '.00%' AS probability_text
FROM (SELECT *, unnest(range(1, least(len(dx), 3) + 1)) AS n FROM cases)""",
    "d5_clean_differential": f"""WITH {CASES}
SELECT case_id, CASE WHEN dx_ok THEN array_to_string(dx, '|') ELSE 'not a list' END AS names FROM cases""",
    "d2_printed_list": f"""WITH {PRINTED}
SELECT k AS case_id, CASE WHEN ev_ok THEN len(ev) END::bigint AS n,
  CASE WHEN ev_ok THEN array_to_string(ev, '|') END AS codes FROM printed""",
    "d4b_printed_differential": f"""WITH {PRINTED},
named AS (
  SELECT *, CASE WHEN dx_ok THEN list_transform(list_filter(dx, lambda x: x.kind IN (0, 2)), lambda x: x.name) ELSE [] END AS names
  FROM printed
)
SELECT k AS case_id, array_to_string(CASE WHEN list_contains(names, truth) THEN names ELSE list_append(names, truth) END, '|') AS names,
  NOT dx_ok AS unreadable FROM named""",
    "d5_printed_differential": f"""WITH {PRINTED}
SELECT k AS case_id, CASE WHEN dx_ok THEN array_to_string(list_transform(dx, lambda x: CASE WHEN x.kind = 3 THEN 'None' ELSE x.name END), '|')
  ELSE '[(1]' END AS names FROM printed""",
    "d6a_decode_name": f"""WITH {CASES}, {CODES}
SELECT case_id, initial AS "INITIAL_EVIDENCE",
  coalesce(CASE WHEN plain THEN p_name END, name, initial) AS complaint
FROM cases LEFT JOIN codes ON initial = code""",
    "d6b_decode_question": f"""WITH {CASES}, {CODES}
SELECT case_id, initial AS "INITIAL_EVIDENCE", coalesce(question, name, initial) AS complaint
FROM cases LEFT JOIN codes ON initial = code""",
    "d6c_decode_list": f"""WITH {CASES}, {CODES}, {SAID},
texts AS (
  SELECT case_id, string_agg({CODE_TEXT}, '|' ORDER BY pos) AS texts
  FROM listed LEFT JOIN codes ON listed.code = codes.code WHERE pos <= 8 GROUP BY case_id
)
SELECT case_id, coalesce(texts, '') AS texts, greatest(len(ev) - 8, 0) AS more
FROM cases LEFT JOIN texts USING (case_id)""",
    "d7_decode_symptoms": f"""WITH {CASES}, {CODES}, {SAID}
SELECT case_id, symptoms FROM symptoms""",
    "d8_sex_text": f"""WITH {GAPS}
SELECT case_id, CASE WHEN sex = 'M' THEN 'Male' ELSE 'Female' END AS sex FROM gaps""",
    "d10_severe_block": f"""WITH {SEVERE} SELECT {SEVERE_TEXT} AS severe_disease_list""",
    "d11_evidence_lookup_name": f"""WITH {CODES}
SELECT code, coalesce(name, '') AS name, coalesce(kind, '') AS type FROM codes WHERE NOT plain""",
    "d11_evidence_lookup_symptom": f"""WITH {CODES}
SELECT code, coalesce(question, name, code) AS symptom, coalesce(kind, 'unknown') AS type FROM codes""",
    "d12_explode_options": f"""WITH {QA}
SELECT qa_id, split, answer_idx, option, source || '-' || (ascii(option) - 65) AS option_text,
  coalesce(option = answer_idx, false) AS is_answer
FROM (SELECT *, unnest(['A', 'B', 'C', 'D']) AS option FROM qa) WHERE has_four OR option <> 'D'""",
    "d13_normalise_evidence": f"""WITH {CASES}
SELECT case_id, CASE WHEN initial IS NULL THEN 0 ELSE 1 END::bigint AS n, coalesce(initial, '') AS codes
FROM cases""",
    "f1_training_record_a": f"""WITH {CASES}, {CODES}, {SAID},
texts AS (
  SELECT case_id, string_agg({CODE_TEXT}, ', ' ORDER BY pos) FILTER (pos <= 10) AS texts, count(*) AS shown
  FROM listed LEFT JOIN codes ON listed.code = codes.code WHERE pos <= 15 GROUP BY case_id
)
SELECT case_id, {prompt(fixed.QUESTION_RECORD, age='age', sex='sex',
    symptoms="coalesce(texts, '') || CASE WHEN shown > 10 THEN " + prompt(fixed.QUESTION_RECORD_MORE, more='shown - 10')
    + " ELSE '' END")} AS instruction,
  '' AS input,
  truth || CASE WHEN len(dx) > 0 THEN {prompt(fixed.QUESTION_RECORD_DIFFERENTIAL, names="array_to_string(dx[1:3], ', ')")}
    ELSE '' END AS output,
  age, sex, truth AS pathology
FROM cases LEFT JOIN texts USING (case_id)""",
    "f2_training_record_b": f"""WITH {CASES}
SELECT case_id, {literal(fixed.LABEL_RECORD_INSTRUCTION)} AS instruction, {LABEL_INPUT} AS input, truth AS output
FROM cases""",
    "f3_user_prompt": f"""WITH {CASES}, {CODES}, {SAID}
SELECT case_id, {prompt(fixed.CASE_PROMPT, **CASE_FIELDS)} AS user_prompt FROM asked""",
    "f4_user_prompt_rules": f"""WITH {CASES}, {CODES}, {SAID}, {SEVERE}
SELECT case_id, {prompt(fixed.CASE_PROMPT_WITH_RULES, threshold='threshold::double', severe=SEVERE_TEXT, **CASE_FIELDS)}
  AS user_prompt
FROM asked""",
    "f6_to_messages": f"""WITH {CASES}, texts AS (
  SELECT case_id, [{literal(fixed.LABEL_RECORD_INSTRUCTION)}, {LABEL_INPUT}, truth] AS contents FROM cases)
SELECT case_id, n - 1 AS pos, ['system', 'user', 'assistant'][n] AS role, contents[n] AS content
FROM (SELECT *, unnest(range(1, 4)) AS n FROM texts)""",
    "r1_strip_fence": f"""WITH {RESPONSES}
SELECT case_id, CASE WHEN form IN (1, 2) THEN chr(10) || whole || chr(10) ELSE raw END AS body FROM responses""",
    "r2_parse_response": f"""WITH {PARSED}
SELECT case_id, predicted AS predicted_disease, confidence AS model_confidence, final_reason,
  form IN (0, 1, 2, 4, 8, 9, 10) AS parse_ok,
  CASE WHEN form = 8 THEN 'not the expected JSON object' WHEN form IN (3, 5, 6, 7) THEN 'not valid JSON' END
    AS parse_error
FROM parsed""",
    "r3_flatten_top3": f"""WITH {PARSED}
SELECT case_id, CASE WHEN is_object THEN n1 END AS rank1_disease, CASE WHEN is_object THEN s1 / 100 END AS rank1_confidence,
  CASE WHEN is_object THEN n2 END AS rank2_disease, CASE WHEN is_object THEN s2 / 100 END AS rank2_confidence,
  CASE WHEN is_object THEN n3 END AS rank3_disease, CASE WHEN is_object THEN s3 / 100 END AS rank3_confidence,
  final_reason
FROM parsed""",
    "r4_score_match": f"""WITH {PARSED}
SELECT case_id, judged AS diagnosis_for_accuracy, is_correct, CASE WHEN is_correct THEN '✓' ELSE '✗' END AS correct,
  CASE WHEN is_correct THEN CASE WHEN lower(judged) = lower(truth) THEN 'Exact' ELSE 'Partial' END END AS match_type
FROM marked""",
    "r5_extract_regex": f"""WITH {DECIDED}
SELECT case_id, disease AS predicted_rank1_disease, confidence AS predicted_rank1_confidence FROM extracted""",
    "r6_is_referral": f"""WITH {PARSED}
SELECT case_id, coalesce(predicted = '{fixed.REFER}', false) AS is_referral FROM parsed""",
    "r7_assemble_results": f"""WITH {PARSED}, {CODES}, {SAID}, {SEVERE},
sampled AS (SELECT *, case_id + 1 AS case_num FROM marked)
{RESULTS}""",
    "a1_sampled_run": f"""WITH {PARSED}, {CODES}, {SAID}, {SEVERE},
sampled AS (
  SELECT *, row_number() OVER (ORDER BY {HASH}, case_id) AS case_num FROM marked QUALIFY case_num <= 1000
)
{RESULTS}""",
    "a1_messages": f"""WITH {CASES}, {CODES}, {SAID}, {SEVERE},
sampled AS (
  SELECT case_id, {prompt(fixed.CASE_PROMPT_WITH_RULES, threshold='threshold::double', severe=SEVERE_TEXT, **CASE_FIELDS)}
    AS user_prompt
  FROM asked QUALIFY row_number() OVER (ORDER BY {HASH}, case_id) <= 1000)
SELECT case_id, n - 1 AS pos, ['system', 'user'][n] AS role, [{literal(fixed.SYSTEM_PROMPT)}, user_prompt][n] AS content
FROM (SELECT *, unnest(range(1, 3)) AS n FROM sampled)""",
    "l3b_severe_default": f"""WITH names AS (SELECT [{', '.join(literal(n) for n in sorted(fixed.SEVERE_DEFAULT))}] AS names),
said AS (
  SELECT o_orderkey AS case_id, o_orderkey % (len(names) + 3) < len(names) AS is_severe FROM orders, names)
SELECT case_id, is_severe, CASE WHEN is_severe THEN '{fixed.REFER}' ELSE 'Flu' END AS decision FROM said""",
    "s2_code_entries": f"""WITH {CODES}
SELECT code, name, question AS question_en, kind AS data_type, CASE WHEN NOT plain THEN p_brand || '-1' END AS first_value,
  CASE WHEN plain THEN p_name END AS entry_text
FROM codes""",
    "s5_split_corpus_docs": f"""WITH {CORPUS}
SELECT path, category, doc_id || '.txt' AS filename, text FROM corpus
WHERE doc_id % 29 <> 28 AND {words('text')} > 0""",
    "s5_split_corpus_failures": f"""WITH {CORPUS}
SELECT path, 'text is not valid UTF-8' AS error FROM corpus WHERE doc_id % 29 = 28""",
    "r8_running_accuracy": f"""WITH {PARSED}, {RUNNING.format("true")}""",
    "r8_running_accuracy_gaps": f"""WITH {PARSED}, {RUNNING.format("(case_id + 1) % 7 <> 3 AND case_id // 50 % 11 <> 5")}""",
    "r9_first_line": f"""WITH {RESPONSES}
SELECT case_id, split_part(raw, chr(10), 1) AS label FROM responses""",
    "l1_count_options": f"""WITH {CASES}
SELECT case_id, len(names) AS number_of_options, array_to_string(names, '|') AS option_names FROM cases""",
    "l2_dynamic_threshold": f"""WITH {CASES}
SELECT case_id, 2 / len(names) AS threshold FROM cases""",
    "l3_decide": f"""WITH {DECIDED}
SELECT case_id, CASE WHEN is_severe OR low THEN '{fixed.REFER}' ELSE disease END AS rank1_disease,
  confidence AS rank1_confidence
FROM decided""",
    "l4_decide_with_reason": f"""WITH {DECIDED}
SELECT case_id, is_severe,
  CASE WHEN is_severe OR low OR confidence IS NULL THEN '{fixed.REFER}' ELSE disease END AS decision,
  CASE WHEN is_severe THEN 'severity' WHEN low OR confidence IS NULL THEN 'low_confidence' ELSE 'none' END
    AS refer_reason
FROM decided""",
    "l5_to_scoring": f"""WITH {DECIDED}
SELECT case_id, correct, confidence, len(names) AS num_options,
  CASE WHEN referred THEN 'REFER' ELSE 'DIAGNOSE' END AS action, is_severe, above AS high_confidence,
  CASE WHEN is_severe THEN 'severity' WHEN low THEN 'low_confidence' END AS refer_reason
FROM flags""",
    "e1_normalise_scored": f"""WITH {SCORED}
SELECT case_id, correct, confidence, num_options, is_referral, is_severe, high_confidence FROM scored""",
    "e2_threshold_stats": f"""WITH {CASES}
SELECT min(2 / len(names)) AS threshold_min, max(2 / len(names)) AS threshold_max,
  round(avg(2 / len(names)), 6) AS threshold_mean
FROM cases""",
    "e3_passk_flags": f"""WITH {SCORED},
t AS (
  SELECT *, is_referral AS referred,
    CASE WHEN num_options IS NULL OR confidence IS NULL OR num_options = 0 THEN false
      ELSE confidence > 2 / num_options END AS above
  FROM scored),
flags AS (SELECT * FROM t), {PASSED}
SELECT case_id, above AS above_threshold, is_severe AND NOT referred AS severe_not_referred,
  above AND correct AND NOT (is_severe AND NOT referred) AS success_correct_dx,
  is_severe AND referred AS success_severe_referred, NOT above AND referred AS success_low_conf_referred,
  passed AS pass_at_1_success,
  NOT passed AND NOT (is_severe AND NOT referred) AND (above OR referred) AS fail_wrong_dx,
  is_severe AND NOT referred AS fail_severe_not_referred,
  NOT above AND NOT referred AND NOT is_severe AS fail_low_conf_not_referred
FROM passing""",
    "e4_passk_summary": f"""WITH {DECIDED}, {PASSED}
SELECT {OUTCOMES}, true AS partition_ok FROM passing""",
    "e6_decision_breakdown": f"""WITH {DECIDED}
SELECT referred AS is_referral, count(*) AS cases, count(*) / (SELECT count(*) FROM orders) * 100 AS coverage_pct,
  count(*) FILTER (correct) AS correct, count(*) FILTER (correct) / count(*) * 100 AS accuracy_pct
FROM flags GROUP BY referred""",
    "e7_refer_reasons": f"""WITH {DECIDED},
reasons AS (SELECT CASE WHEN is_severe THEN 'severity' ELSE 'low_confidence' END AS refer_reason FROM flags WHERE referred)
SELECT refer_reason, count(*) AS cases, count(*) / (SELECT count(*) FROM orders) * 100 AS share_pct
FROM reasons GROUP BY refer_reason""",
    "e8_safety_check": f"""WITH {DECIDED},
sides AS (
  SELECT count(*) FILTER (NOT referred) AS diagnosed, count(*) FILTER (referred) AS referred,
    count(*) FILTER (NOT referred AND correct) AS right_d, count(*) FILTER (referred AND correct) AS right_r
  FROM flags)
SELECT diagnosed, referred, round(right_d / diagnosed * 100, 6) AS diagnosed_accuracy,
  round(right_r / referred * 100, 6) AS referred_accuracy,
  CASE WHEN right_d / diagnosed > right_r / referred THEN 'passed' ELSE 'check' END AS safety
FROM sides""",
    "e9_calibration": f"""WITH {DECIDED},
means AS (
  SELECT avg(confidence) AS a, avg(confidence) FILTER (correct) AS r, avg(confidence) FILTER (NOT correct) AS w FROM flags)
SELECT round(a, 6) AS confidence_all, round(r, 6) AS confidence_correct, round(w, 6) AS confidence_wrong,
  CASE WHEN r > w THEN 'good' ELSE 'poor' END AS calibration
FROM means""",
    "e10_accuracy": f"""WITH {PARSED}
SELECT count(*) AS cases, count(*) FILTER (is_correct) AS correct,
  count(*) FILTER (is_correct) / count(*) * 100 AS accuracy_pct
FROM marked""",
    "e10_label_accuracy": f"""WITH {PARSED}
SELECT count(*) AS cases, count(*) FILTER (truth = rank1) AS correct, count(*) FILTER (truth = rank1) / count(*) AS accuracy
FROM marked""",
}

PER_CLASS = f"""{PARSED},
labels_seen AS (SELECT truth AS label FROM marked UNION SELECT rank1 FROM marked WHERE rank1 IS NOT NULL),
per_class AS (
  SELECT label, (SELECT count(*) FROM marked WHERE truth = label) AS support,
    (SELECT count(*) FROM marked WHERE rank1 = label) AS predicted,
    (SELECT count(*) FROM marked WHERE rank1 = label AND truth = label) AS hits
  FROM labels_seen),
scores AS (
  SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS precision,
    CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall,
    CASE WHEN predicted + support > 0 THEN 2 * hits / (predicted + support) ELSE 0 END AS f1
  FROM per_class)"""

# The four runs of the comparison, by severe set and treatment of a missing confidence.
PHASES = f"""{DECIDED},
variants AS (
  SELECT 'no severe set' AS phase, correct, false AS is_severe, low AS referred, above, false AS for_severity FROM flags
  UNION ALL SELECT 'missing passes', correct, is_severe, referred, above, is_severe FROM flags
  UNION ALL SELECT 'missing refers', correct, is_severe, referred OR confidence IS NULL, above, is_severe FROM flags
  UNION ALL SELECT 'severe truth', correct, truth IN (SELECT disease FROM severe), referred, above, is_severe FROM flags),
passing AS (
  SELECT *, (above AND correct AND NOT (is_severe AND NOT referred)) OR (is_severe AND referred)
    OR (NOT above AND referred) AS passed
  FROM variants)"""

BOXES = """
quartiles AS (
  SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
    quantile_cont(value, 0.75) AS q3
  FROM events GROUP BY event_type)"""


def term_rows(terms: tuple[str, ...]) -> str:
    rows = [
        f"SELECT {literal(t)} AS term, sum((length(lower(text)) - length(replace(lower(text), {literal(t)}, '')))"
        f" // {len(t)})::bigint AS n, count(*) AS docs FROM documents"
        for t in terms
    ]
    return "\nUNION ALL ".join(rows)


def histogram(source: str, by: str, bins: int) -> str:
    keys = f"{by}, " if by else ""
    match = f"r.{by} = b.{by} AND " if by else ""
    return f"""
ends AS (SELECT {keys}min(v) AS lo, max(v) AS hi FROM {source} {'GROUP BY ' + by if by else ''}),
boxes AS (SELECT *, unnest(range(1, {bins + 1})) AS bin FROM ends),
ranked AS (
  SELECT {'s.' + by + ', ' if by else ''}least(floor((v - lo) * {bins} / (hi - lo)) + 1, {bins})::bigint AS bin
  FROM {source} s JOIN ends e ON {'s.' + by + ' = e.' + by if by else 'true'}
  WHERE v IS NOT NULL),
filled AS (SELECT {keys}bin, count(*) AS n FROM ranked GROUP BY {keys}bin)
SELECT {'b.' + by + ', ' if by else ''}b.bin, lo + (b.bin - 1) * ((hi - lo) / {bins}) AS bin_start,
  lo + b.bin * ((hi - lo) / {bins}) AS bin_end, coalesce(n, 0) AS n
FROM boxes b LEFT JOIN filled r ON {match}r.bin = b.bin"""


ORACLES |= {
    "e11_prf": f"""WITH {PER_CLASS} SELECT label, support, predicted, hits, precision, recall, f1 FROM scores""",
    "e11_prf_averages": f"""WITH {PER_CLASS}
SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall,
  round(avg(f1), 6) AS macro_f1, round(sum(hits) / sum(predicted), 6) AS micro_precision,
  round(sum(hits) / sum(support), 6) AS micro_recall,
  round(2 * sum(hits) / (sum(predicted) + sum(support)), 6) AS micro_f1
FROM scores""",
    "e12_outcome_table": f"""WITH {DECIDED}, {PASSED}, summary AS (SELECT {OUTCOMES} FROM passing)
SELECT 'success' AS outcome, successes AS cases, successes / total * 100 AS share_pct FROM summary
UNION ALL SELECT 'fail_wrong_dx', fail_wrong_dx, fail_wrong_dx / total * 100 FROM summary
UNION ALL SELECT 'fail_severe_not_referred', fail_severe_not_referred, fail_severe_not_referred / total * 100 FROM summary
UNION ALL SELECT 'fail_low_conf_not_referred', fail_low_conf_not_referred, fail_low_conf_not_referred / total * 100
FROM summary""",
    "e13_compare_phases": f"""WITH {PHASES}
SELECT phase, {OUTCOMES} FROM passing GROUP BY phase""",
    "e13_outcome_margins": f"""WITH {PHASES},
cells AS (
  SELECT *, referred AS is_referral, CASE WHEN for_severity THEN 'severity' WHEN referred THEN 'low_confidence' END AS refer_reason
  FROM passing)
SELECT phase, is_referral, refer_reason, is_severe, GROUPING(phase, is_referral, refer_reason, is_severe)::bigint AS margin,
  count(*) AS total, count(*) FILTER (correct) AS correct, count(*) FILTER (passed) AS successes,
  count(*) FILTER (NOT passed AND NOT (is_severe AND NOT referred) AND (above OR referred)) AS fail_wrong_dx,
  count(*) FILTER (is_severe AND NOT referred) AS fail_severe_not_referred,
  count(*) FILTER (NOT above AND NOT referred AND NOT is_severe) AS fail_low_conf_not_referred,
  count(*) FILTER (correct) / count(*) * 100 AS accuracy, count(*) FILTER (passed) / count(*) * 100 AS pass_at_1
FROM cells GROUP BY CUBE (phase, is_referral, refer_reason, is_severe)""",
    "f6_conversation_messages": """SELECT conv_id, turn // 4 AS part, count(*) AS turns,
  string_agg(concat_ws(': ', role, text), chr(10) ORDER BY turn, role, text) AS messages
FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL""",
    "e14_run_report": f"""WITH {DECIDED}, {PASSED},
summary AS (
  SELECT {OUTCOMES}, min(threshold) AS threshold_min, max(threshold) AS threshold_max, avg(threshold) AS tm,
    count(*) FILTER (NOT referred) AS diagnosed, count(*) FILTER (referred) AS referred,
    count(*) FILTER (NOT referred AND correct) / count(*) FILTER (NOT referred) * 100 AS da,
    count(*) FILTER (referred AND correct) / count(*) FILTER (referred) * 100 AS ra,
    avg(confidence) AS ca, avg(confidence) FILTER (correct) AS cc, avg(confidence) FILTER (NOT correct) AS cw
  FROM passing)
SELECT * EXCLUDE (tm, da, ra, ca, cc, cw), round(tm, 6) AS threshold_mean, round(da, 6) AS diagnosed_accuracy,
  round(ra, 6) AS referred_accuracy, round(ca, 6) AS confidence_all, round(cc, 6) AS confidence_correct,
  round(cw, 6) AS confidence_wrong, diagnosed / total * 100 AS diagnosed_pct, referred / total * 100 AS referred_pct,
  CASE WHEN da > ra THEN 'passed' ELSE 'check' END AS safety, CASE WHEN cc > cw THEN 'good' ELSE 'poor' END AS calibration
FROM summary""",
    "q1_split_sizes": f"""WITH {CASES}
SELECT split, count(*) AS rows, (SELECT count(*) FROM orders) AS total,
  count(*) / (SELECT count(*) FROM orders) * 100 AS share_pct
FROM cases GROUP BY split""",
    "q2_field_profile": f"""WITH {QA}, first_row AS (SELECT * FROM qa ORDER BY qa_id LIMIT 1)
SELECT 'qa_id' AS field, 'int' AS type, NULL::bigint AS length, NULL::varchar AS keys FROM first_row
UNION ALL SELECT 'split', 'str', NULL, NULL FROM first_row
UNION ALL SELECT 'options', 'dict', NULL, 'A, B, C' FROM first_row
UNION ALL SELECT 'answer_idx', 'str', NULL, NULL FROM first_row""",
    "q3_value_counts": f"""WITH {GAPS},
counts AS (SELECT truth AS value, count(*) AS n, min(case_id) AS first_seen FROM gaps GROUP BY truth)
SELECT value, n, n / (SELECT count(*) FROM orders) * 100 AS share_pct, (SELECT count(*) FROM counts) AS distinct_values
FROM counts ORDER BY n DESC, first_seen LIMIT 15""",
    "q4a_balance_top": f"""WITH {CASES}, counts AS (SELECT truth, count(*) AS n FROM cases GROUP BY truth)
SELECT max(n) / sum(n) * 100 AS top_share_pct, max(n) / sum(n) * 100 < 10 AS balanced FROM counts""",
    "q4b_balance_band": f"""WITH {QA},
shares AS (
  SELECT split, count(*) AS n, count(*) FILTER (answer_idx = 'A') AS a, count(*) FILTER (answer_idx = 'B') AS b,
    count(*) FILTER (answer_idx = 'C') AS c, count(*) FILTER (answer_idx = 'D') AS d
  FROM qa GROUP BY split)
SELECT split, least(a, b, c, d) / n * 100 >= 20 AND greatest(a, b, c, d) / n * 100 <= 30 AS balanced FROM shares""",
    "q5_evidence_counts": f"""WITH {CASES},
items AS (SELECT case_id, unnest(ev) AS value, generate_subscripts(ev, 1) AS pos FROM cases),
counts AS (SELECT value, count(*) AS n, min(case_id * 1000 + pos) AS first_seen FROM items GROUP BY value)
SELECT value, n, n / (SELECT count(*) FROM items) * 100 AS share_pct, (SELECT count(*) FROM counts) AS distinct_values
FROM counts ORDER BY n DESC, first_seen LIMIT 20""",
    "q6_numeric_stats": """SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median,
  min(value) AS min, max(value) AS max
FROM events GROUP BY event_type""",
    "q6_numeric_stats_all": f"""WITH {GAPS}
SELECT avg(age) AS mean, median(age) AS median, min(age) AS min, max(age) AS max FROM gaps""",
    "q7_category_share": f"""WITH {GAPS}
SELECT sex AS value, count(*) AS n, count(*) / (SELECT count(*) FROM gaps) * 100 AS share_pct
FROM gaps WHERE sex <> '' GROUP BY sex""",
    "q7_category_share_shown": f"""WITH {GAPS}
SELECT sex AS value, count(*) AS n, count(*) / (SELECT count(*) FROM gaps WHERE sex <> '') * 100 AS share_pct
FROM gaps WHERE sex <> '' GROUP BY sex""",
    "q8_completeness": f"""WITH {GAPS},
counts AS (
  SELECT count(*) AS total, count(*) FILTER (truth IS NULL) AS missing_label,
    count(*) FILTER (initial IS NULL AND evidences IS NULL) AS missing_evidence,
    count(*) FILTER (truth IS NOT NULL AND (initial IS NOT NULL OR evidences IS NOT NULL)) AS complete_exact
  FROM gaps)
SELECT *, total - missing_label - missing_evidence AS complete_reference,
  (total - missing_label - missing_evidence) / total * 100 AS complete_pct,
  CASE WHEN missing_label + missing_evidence = 0 THEN 'EXCELLENT' ELSE 'GOOD' END AS grade
FROM counts""",
    "q9_qa_checklist": f"""WITH {QA},
facts AS (
  SELECT count(DISTINCT split) = 2 AS both_splits, arg_min(has_four, qa_id) FILTER (split = 'train') AS four FROM qa)
SELECT 'required_splits' AS "check", both_splits AS passed FROM facts
UNION ALL SELECT 'splits_not_empty', both_splits FROM facts
UNION ALL SELECT 'required_fields', true FROM facts
UNION ALL SELECT 'four_options', four FROM facts
UNION ALL SELECT 'all', both_splits AND four FROM facts""",
    "q9_qa_checklist_every_row": f"""WITH {QA},
facts AS (
  SELECT count(DISTINCT split) = 2 AS both_splits, arg_min(has_four, qa_id) FILTER (split = 'train') AS four,
    bool_and(has_four) FILTER (split = 'train') AS every FROM qa)
SELECT 'required_splits' AS "check", both_splits AS passed FROM facts
UNION ALL SELECT 'splits_not_empty', both_splits FROM facts
UNION ALL SELECT 'required_fields', true FROM facts
UNION ALL SELECT 'four_options', four FROM facts
UNION ALL SELECT 'four_options_every_row', every FROM facts
UNION ALL SELECT 'all', both_splits AND four AND every FROM facts""",
    "q10_answer_distribution": f"""WITH {QA},
wide AS (SELECT split, answer_idx, unnest(['A', 'B', 'C', 'D']) AS answer FROM qa)
SELECT split, answer, count(*) FILTER (answer_idx = answer) AS n,
  count(*) FILTER (answer_idx = answer) / count(*) * 100 AS share_pct
FROM wide GROUP BY split, answer""",
    "q11_length_stats": f"""WITH tall AS (
  SELECT lang, 'words' AS measure, {words('text')} AS n FROM documents
  UNION ALL SELECT lang, 'chars', length(text) FROM documents)
SELECT lang, measure, count(*) AS rows, sum(n)::bigint AS total_length, round(avg(n), 6) AS mean, median(n) AS median,
  min(n) AS min, max(n) AS max, round(stddev_pop(n), 6) AS std
FROM tall GROUP BY lang, measure""",
    "q12_length_bands_qa": f"""WITH {QA}, counted AS (SELECT split, coalesce({words('question')}, 0) AS w FROM qa),
{bands('counted', 'split', *fixed.QA_BANDS)}""",
    "q12_length_bands_corpus": f"""WITH counted AS (SELECT {words('text')} AS w FROM documents),
{bands('counted', '', *fixed.CORPUS_BANDS)}""",
    "q13_qa_quality": f"""WITH {QA},
counts AS (
  SELECT split, count(*) AS rows, count(*) FILTER (question IS NULL OR {words('question')} = 0)::bigint AS missing_questions,
    count(*) FILTER (answer_idx IS NULL)::bigint AS missing_answers,
    count(*) - count(DISTINCT question) - max(CASE WHEN question IS NULL THEN 1 ELSE 0 END) AS duplicate_questions,
    count(*) FILTER (NOT has_four)::bigint AS incomplete_options,
    count(*) FILTER (answer_idx IS NULL OR answer_idx = 'E')::bigint AS invalid_answers
  FROM qa GROUP BY split),
told AS (
  SELECT *, array_to_string(list_filter([
    CASE WHEN missing_questions + missing_answers > 0 THEN 'missing data' END,
    CASE WHEN duplicate_questions > 0 THEN duplicate_questions || ' duplicate questions' END,
    CASE WHEN incomplete_options > 0 THEN 'incomplete options' END,
    CASE WHEN invalid_answers > 0 THEN 'invalid answers' END], lambda x: x IS NOT NULL), '; ') AS issues
  FROM counts)
SELECT *, issues = '' AS passed FROM told""",
    "q14_duplicate_count": f"""WITH {QA},
seen AS (SELECT split, count(*) AS n FROM qa GROUP BY split, question)
SELECT split, sum(n)::bigint AS rows, count(*) AS unique_values, (sum(n) - count(*))::bigint AS duplicates
FROM seen GROUP BY split""",
    "q15_term_counts": f"""WITH found AS ({term_rows(('er', 'the', 'on', 'ent', 'ion'))})
SELECT term, n, n / docs AS per_document FROM found""",
    "q16_corpus_quality": f"""WITH counts AS (
  SELECT count(*) AS documents, count(*) FILTER ({words('text')} = 0) AS empty,
    count(*) FILTER ({words('text')} < 100) AS very_short,
    count(*) FILTER (regexp_matches(lower(text), 'er|the|on|ent|ion')) AS with_terms, count(*) AS checked
  FROM documents)
SELECT *, with_terms / checked * 100 AS with_terms_pct,
  CASE WHEN empty < documents * 0.01 AND with_terms > checked * 0.8 THEN 'EXCELLENT' ELSE 'GOOD' END AS grade
FROM counts""",
    "q17_histogram": f"""WITH vals AS (SELECT value AS v FROM events), {histogram('vals', '', 30)}""",
    "q17_histogram_by_split": f"""WITH {QA},
vals AS (SELECT split, {words('question')}::double AS v FROM qa), {histogram('vals', 'split', 50)}""",
    "q18_box_summary": f"""WITH {BOXES}
SELECT event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  least(q1, min(value) FILTER (value >= q1 - 1.5 * (q3 - q1))) AS whisker_low,
  greatest(q3, max(value) FILTER (value <= q3 + 1.5 * (q3 - q1))) AS whisker_high,
  count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers, count(*) AS rows
FROM events JOIN quartiles USING (event_type) GROUP BY event_type, q1, median, q3""",
    "q19_load_rates": """WITH counts AS (
  SELECT (SELECT count(*) FROM documents) AS loaded, (SELECT count(*) FROM labels) AS failed,
    (SELECT count(*) FROM documents) + (SELECT count(*) FROM pages) AS listed,
    (SELECT count(DISTINCT source) FROM documents) AS categories)
SELECT loaded, failed, listed, loaded / (loaded + failed) * 100 AS success_pct, loaded / listed * 100 AS coverage_pct,
  categories, categories + 1 AS categories_listed
FROM counts""",
    "q20_dataset_info": f"""WITH {QA},
first_text AS (SELECT arg_min(question, qa_id) AS question FROM qa WHERE split = 'train')
SELECT 'documents' AS source, split, count(*) AS rows, (SELECT count(*) FROM qa) AS total_examples,
  'qa_id, question, options, answer_idx' AS fields, (SELECT {words('question')} FROM first_text) AS sample_question_length
FROM qa GROUP BY split""",
}
