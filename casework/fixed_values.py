"""Lists, texts, patterns and limits whose exact content the results depend on."""

# Texts of decisions, defaults and marks.
REFER = "Refer to specialist"
DEFAULT_COMPLAINT = "patient presents with medical complaint"
UNKNOWN = "Unknown"
RIGHT_MARK = "✓"
WRONG_MARK = "✗"

# Diseases that are always referred.
SEVERE_DEFAULT = (
    "Possible NSTEMI / STEMI",
    "Unstable angina",
    "Anaphylaxis",
    "Pulmonary embolism",
    "Spontaneous pneumothorax",
    "Acute pulmonary edema",
    "Epiglottitis",
    "Boerhaave",
    "Ebola",
    "HIV (initial infection)",
    "Tuberculosis",
    "Pancreatic neoplasm",
    "Pulmonary neoplasm",
    "Guillain-Barré syndrome",
    "Myasthenia gravis",
    "SLE",
    "Chagas",
    "Myocarditis",
    "Pericarditis",
    "Atrial fibrillation",
    "Sarcoidosis",
)

# Texts that count as a true mark (exact and case-sensitive).
TRUTHY = ("✓", "✔", "☑", "true", "True", "1", "yes", "Yes")

# Question words removed from yes/no questions, in this order.
YES_NO_WORDS = ("do you have ", "have you ", "are you ", "did you ", "?")
# Question words removed from valued questions, in this order.
VALUED_WORDS = ("do you ", "have you ")
# Value texts that say nothing.
EMPTY_VALUES = ("", "N", "NA")
# What parts a code from its value, and codes of a case that are told.
CODE_SEPARATOR = "_@_"
SYMPTOM_CAP = 12

# Default terms of the corpus report.
CORPUS_TERMS = (
    "disease", "patient", "treatment", "therapy", "clinical", "diagnosis",
    "symptom", "infection", "cancer", "cell", "cells", "blood", "gene",
    "protein", "study", "research", "medical", "health", "chronic", "acute",
)

# Answers and fields of a multiple-choice question.
ANSWERS = ("A", "B", "C", "D")
QA_FIELDS = ("question", "options", "answer_idx")

# Upper ends (exclusive) and names of the length bands, in words.
QA_BANDS = ((50, 100), ("short", "medium", "long"))
CORPUS_BANDS = ((1000, 3000, 6000, 10000), ("very_short", "short", "medium", "long", "very_long"))

# Cells that a results file uses for "missing".
MISSING_CELLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Prompt and record texts. Named fields are filled in by operators.records.
CASE_PROMPT = """Patient Information:
- Age: {age} years
- Sex: {sex}
- Symptoms: {symptoms}
- Number of evidences: {num_evidences}

diagnosis_options:
{options}

Based on this patient's presentation, provide your diagnostic assessment with the top 3 most likely diagnoses and confidence scores."""

CASE_PROMPT_WITH_RULES = """Patient Information:
- Age: {age} years
- Sex: {sex}
- Symptoms: {symptoms}
- Number of evidences: {num_evidences}
- confidence_threshold: {threshold}

severe_disease_list:
{severe}



diagnosis_options:
{options}

Based on this patient's presentation, provide your diagnostic assessment with the top 3 most likely diagnoses and confidence scores."""

SYSTEM_PROMPT = """You are a medical diagnosis assistant for a research prototype.

Task:
Choose the top 3 most likely diseases from the provided diagnosis_options, then apply the final decision rule.

Rules:
1. Return valid JSON only.
2. Use only diseases from diagnosis_options.
3. Return exactly 3 predictions ranked by likelihood.
4. Each prediction must include rank, disease, and confidence.
5. Confidence must be between 0 and 1.
6. Apply the final decision rule exactly.
7. Do not provide treatment advice.

Final decision rule:
- If rank 1 disease is in severe_disease_list, final_prediction disease must be "Refer to specialist" and reason must be "severity".
- Else if rank 1 confidence < confidence_threshold, final_prediction disease must be "Refer to specialist" and reason must be "low_confidence".
- Else final_prediction disease must be rank 1 disease and reason must be "none".

Return JSON in this format:
{
  "top_3_predictions": [
    {"rank": 1, "disease": "Disease Name", "confidence": 0.6},
    {"rank": 2, "disease": "Disease Name", "confidence": 0.25},
    {"rank": 3, "disease": "Disease Name", "confidence": 0.15}
  ],
  "final_prediction": {
    "disease": "Disease Name or Refer to specialist",
    "reason": "none or severity or low_confidence",
    "confidence": 0.6
  }
}
"""

QUESTION_RECORD = """A {age}-year-old {sex} patient presents with the following:

Symptoms: {symptoms}

What is the most likely diagnosis?"""
QUESTION_RECORD_MORE = ", and {more} other symptoms"
QUESTION_RECORD_DIFFERENTIAL = "\n\nDifferential diagnosis to consider: {names}"

LABEL_RECORD_INSTRUCTION = "Based on the patient symptoms, provide only the final diagnosis label."
LABEL_RECORD_INPUT = """Patient:
- Age: {age}
- Sex: {sex}
- Initial evidence: {initial}
- Evidences: {evidences}
- Possible diagnoses: {differential}"""
