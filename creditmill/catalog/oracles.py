"""The same results in SQL, written independently, for DuckDB."""

from __future__ import annotations

import re

from creditmill.catalog import samples
from creditmill.catalog.queries import QUESTIONS, VECTORS

_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _portable(text: str) -> str:
    text = text.replace("{series}", "unnest(range(1, 6))")
    text = text.replace("{series3}", "unnest(range(1, 4))")
    return re.sub(r"\{(\w+)\}", r"\1", text)


def _trim(column: str) -> str:
    return f"trim({column}, {_WS})"


def _number(column: str) -> str:
    plain = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
    return (
        f"CASE WHEN regexp_full_match({_trim(column)}, '{plain}') "
        f"THEN TRY_CAST({_trim(column)} AS DOUBLE) END"
    )


def _d(value: float) -> str:
    return f"CAST({value} AS DOUBLE)"


def _dec(expression: str, kind: str) -> str:
    return f"TRY_CAST(TRY_CAST({expression} AS DECIMAL(38,10)) AS {kind})"


_CLEAN = f"""
SELECT row_no,
  CASE WHEN {_number('person_age')} > 100 THEN 100.0::DOUBLE ELSE {_number('person_age')} END AS person_age,
  lower({_trim('person_gender')}) AS person_gender,
  CASE {_trim('person_education')} WHEN 'Doctorate' THEN 'Doctor'
       ELSE {_trim('person_education')} END AS person_education,
  {_number('person_income')} AS person_income,
  {_number('person_emp_exp')} AS person_emp_exp,
  upper({_trim('person_home_ownership')}) AS person_home_ownership,
  {_number('loan_amnt')} AS loan_amnt,
  CASE {_trim('loan_intent')} WHEN 'HOMEIMPROVEMENT' THEN 'HOME_IMPROVEMENT'
       ELSE {_trim('loan_intent')} END AS loan_intent,
  {_number('loan_int_rate')} AS loan_int_rate,
  {_number('loan_percent_income')} AS loan_percent_income,
  {_number('cb_person_cred_hist_length')} AS cb_person_cred_hist_length,
  {_number('credit_score')} AS credit_score,
  coalesce({_trim('previous_loan_defaults_on_file')} <> 'No', true) AS previous_loan_defaults_on_file,
  loan_status
FROM loan_raw
"""

_LOCAL = f"""
SELECT *,
  loan_percent_income AS debt_to_income_ratio,
  loan_percent_income AS loan_to_income_ratio,
  CASE WHEN person_age > 0 THEN cb_person_cred_hist_length / person_age END AS credit_history_to_age_ratio,
  person_income / 12.0 AS monthly_income,
  loan_amnt * (1 + loan_int_rate / 100) / 12.0 AS monthly_loan_burden,
  CASE WHEN person_income / 12.0 > 0 THEN
    CASE WHEN 1.0 - (loan_amnt * (1 + loan_int_rate / 100) / 12.0) / (person_income / 12.0) < 0 THEN 0.0
         ELSE 1.0 - (loan_amnt * (1 + loan_int_rate / 100) / 12.0) / (person_income / 12.0) END
  END AS affordability_ratio,
  CASE WHEN person_age > 0 THEN person_emp_exp / person_age END AS emp_to_age_ratio,
  CASE WHEN person_age > 0 THEN loan_amnt / person_age END AS loan_per_age,
  coalesce(person_age < 25 AND person_emp_exp = 0, false) AS young_inexperienced,
  CASE WHEN credit_score BETWEEN 800 AND 850 THEN 'Exceptional'
       WHEN credit_score BETWEEN 740 AND 799 THEN 'Very Good'
       WHEN credit_score BETWEEN 670 AND 739 THEN 'Good'
       WHEN credit_score BETWEEN 580 AND 669 THEN 'Fair' ELSE 'Poor' END AS credit_score_tier,
  coalesce(cb_person_cred_hist_length < 2, false) AS thin_credit_file,
  CASE WHEN cb_person_cred_hist_length > 0 THEN credit_score / cb_person_cred_hist_length END
    AS score_per_history_year,
  coalesce(loan_int_rate > (SELECT median(loan_int_rate) FROM clean)
       AND credit_score < (SELECT median(credit_score) FROM clean), false) AS credit_risk_interaction,
  CASE WHEN person_income <= 47204 THEN 'low' WHEN person_income <= 67048 THEN 'mid_low'
       WHEN person_income <= 95789 THEN 'medium' ELSE 'high' END AS income_bucket,
  coalesce(loan_percent_income > {_d(0.30)}, false) AS high_loan_burden_flag,
  CASE WHEN person_emp_exp >= 2 THEN 'stable' ELSE 'unstable' END AS employment_stability,
  CAST(CASE person_home_ownership WHEN 'RENT' THEN 1 WHEN 'MORTGAGE' THEN 2 WHEN 'OWN' THEN 3
       ELSE 0 END AS INTEGER) AS homeownership_score,
  CAST(CASE upper(loan_intent) WHEN 'EDUCATION' THEN 0 WHEN 'HOMEIMPROVEMENT' THEN 1
       WHEN 'HOME_IMPROVEMENT' THEN 1 WHEN 'PERSONAL' THEN 2 WHEN 'MEDICAL' THEN 3
       WHEN 'DEBTCONSOLIDATION' THEN 4 WHEN 'VENTURE' THEN 5 ELSE 2 END AS INTEGER)
    AS intent_risk_score,
  '1.0.0' AS pipeline_version
FROM clean
"""


def _signal(condition: str, weight: float) -> str:
    return f"CAST(coalesce({condition}, false) AS DOUBLE) * {_d(weight)}"


_SCORED = f"""
SELECT *, round(
    {_signal(f'debt_to_income_ratio > {_d(0.40)}', 0.20)}
  + {_signal(f'loan_to_income_ratio > {_d(0.40)}', 0.15)}
  + {_signal('thin_credit_file', 0.10)}
  + {_signal('credit_risk_interaction', 0.15)}
  + {_signal('high_loan_burden_flag', 0.10)}
  + {_signal('previous_loan_defaults_on_file', 0.20)}
  + {_signal('young_inexperienced', 0.10)}, 6) AS composite_risk_score,
  round(homeownership_score * ln(1 + person_income), 6) AS stability_income_interaction
FROM local_features
"""

_FEATURES = f"""
SELECT *, composite_risk_score >=
    (SELECT quantile_cont(composite_risk_score, {_d(0.75)}) FROM scored) AS is_high_risk
FROM scored
"""

_RAW_NUMBERS = (
    "person_age",
    "person_income",
    "person_emp_exp",
    "loan_amnt",
    "loan_int_rate",
    "loan_percent_income",
    "cb_person_cred_hist_length",
    "credit_score",
)
_RATIOS = (
    "debt_to_income_ratio",
    "loan_to_income_ratio",
    "credit_history_to_age_ratio",
    "affordability_ratio",
    "emp_to_age_ratio",
)

_TYPED_APPLICANT = f"""
  {_dec('person_age', 'DECIMAL(5,1)')} AS person_age,
  CASE WHEN person_gender IN ('male', 'female', 'other') THEN person_gender END AS person_gender,
  CASE WHEN person_education IN ('High School', 'Bachelor', 'Diploma', 'Associate', 'Master', 'Doctor')
       THEN person_education END AS person_education,
  {_dec('person_income', 'DECIMAL(12,2)')} AS person_income,
  CAST(trunc(person_emp_exp) AS INTEGER) AS person_emp_exp,
  CASE WHEN person_home_ownership IN ('MORTGAGE', 'OTHER', 'OWN', 'RENT')
       THEN person_home_ownership END AS person_home_ownership,
  {_dec('loan_amnt', 'DECIMAL(12,2)')} AS loan_amnt,
  CASE WHEN upper(loan_intent) IN ('DEBTCONSOLIDATION', 'EDUCATION', 'HOME_IMPROVEMENT', 'MEDICAL',
                                   'PERSONAL', 'VENTURE') THEN upper(loan_intent) END AS loan_intent,
  {_dec('loan_int_rate', 'DECIMAL(5,2)')} AS loan_int_rate,
  {_dec('loan_percent_income', 'DECIMAL(5,4)')} AS loan_percent_income,
  {_dec('cb_person_cred_hist_length', 'DECIMAL(4,1)')} AS cb_person_cred_hist_length,
  CAST(trunc(credit_score) AS INTEGER) AS credit_score,
  previous_loan_defaults_on_file,
  CAST(loan_status AS INTEGER) AS loan_status,
  'processed' AS source_split
"""

_TYPED_FEATURES = f"""
  {', '.join(f"{_dec(name, 'DECIMAL(10,6)')} AS {name}" for name in _RATIOS)},
  {_dec('monthly_loan_burden', 'DECIMAL(12,2)')} AS monthly_loan_burden,
  {_dec('monthly_income', 'DECIMAL(12,2)')} AS monthly_income,
  {_dec('loan_per_age', 'DECIMAL(10,4)')} AS loan_per_age,
  young_inexperienced, credit_score_tier, thin_credit_file,
  {_dec('score_per_history_year', 'DECIMAL(10,4)')} AS score_per_history_year,
  credit_risk_interaction, income_bucket, high_loan_burden_flag, employment_stability, is_high_risk,
  {_dec('composite_risk_score', 'DECIMAL(8,6)')} AS composite_risk_score,
  homeownership_score,
  {_dec('stability_income_interaction', 'DECIMAL(12,6)')} AS stability_income_interaction,
  intent_risk_score, pipeline_version
"""

_STORABLE = """person_age IS NOT NULL AND person_home_ownership IS NOT NULL
  AND loan_intent IS NOT NULL AND person_income IS NOT NULL AND person_emp_exp IS NOT NULL
  AND loan_amnt IS NOT NULL AND loan_int_rate IS NOT NULL AND loan_percent_income IS NOT NULL
  AND cb_person_cred_hist_length IS NOT NULL AND credit_score IS NOT NULL"""

_KEYS = "person_income, loan_amnt, credit_score, loan_percent_income"
_ID = (
    "sha256(concat_ws('|', 'loan_applicants', CAST(person_income AS VARCHAR), "
    "CAST(loan_amnt AS VARCHAR), CAST(credit_score AS VARCHAR), CAST(loan_percent_income AS VARCHAR)))"
)
_TERMS = r"regexp_extract_all(lower({0}), '\p{{L}}+')"

# Building blocks; a query gets those it names, directly or through another one.
_BLOCKS = {
    "loan_raw": _portable(samples.LOAN_RAW),
    "clean": _CLEAN,
    "local_features": _LOCAL,
    "scored": _SCORED,
    "features": _FEATURES,
    "batch": (
        "SELECT * FROM features UNION ALL BY NAME "
        "SELECT * REPLACE (row_no + 4503599627370496 AS row_no) FROM features WHERE row_no % 50 = 0"
    ),
    "typed_batch": f"SELECT row_no, {_TYPED_APPLICANT}, {_TYPED_FEATURES} FROM batch",
    "typed": f"SELECT row_no, {_TYPED_APPLICANT}, {_TYPED_FEATURES} FROM features",
    "existing": f"SELECT * FROM typed WHERE row_no % 10 = 3 AND {_STORABLE}",
    "first_rows": (
        f"SELECT * FROM typed_batch WHERE {_STORABLE} "
        f"QUALIFY row_number() OVER (PARTITION BY {_KEYS} ORDER BY row_no) = 1"
    ),
    "new_rows": (
        "SELECT * FROM first_rows f WHERE NOT EXISTS (SELECT 1 FROM existing e "
        "WHERE e.person_income = f.person_income AND e.loan_amnt = f.loan_amnt "
        "AND e.credit_score = f.credit_score AND e.loan_percent_income = f.loan_percent_income)"
    ),
    "applicants": (
        f"SELECT {_ID} AS id, * FROM typed WHERE {_STORABLE} "
        f"QUALIFY row_number() OVER (PARTITION BY {_KEYS} ORDER BY row_no) = 1"
    ),
    "applicant_keys": "SELECT row_no, id AS applicant_id FROM applicants",
    "models": _portable(samples.MODELS),
    "texts": "SELECT doc_id, n_chars FROM documents",
    "predictions": _portable(samples.PREDICTIONS),
    "explanations": _portable(samples.EXPLANATIONS),
    "explanation_chunks": _portable(samples.EXPLANATION_CHUNKS),
    "assessments": _portable(samples.ASSESSMENTS),
    "repeated_predictions": _portable(samples.REPEATED_PREDICTIONS),
    "repeated_assessments": _portable(samples.REPEATED_ASSESSMENTS),
    "long_evaluators": _portable(samples.LONG_EVALUATORS),
    "tokenised": (
        f"SELECT doc_id, source AS source_name, "
        f"string_split_regex({_trim('text')}, '[ \\t\\n\\r\\f]+') AS tokens "
        f"FROM documents WHERE {_trim('text')} <> ''"
    ),
    "chunk_starts": (
        "SELECT *, unnest(range(0, greatest(len(tokens) - 64, 1), 448)) AS start FROM tokenised"
    ),
    "chunks": (
        "SELECT concat_ws('-', 'document', doc_id, start // 448) AS id, source_name, "
        "CAST(start // 448 AS INTEGER) AS chunk_index, "
        "CAST(least(len(tokens) - start, 512) AS INTEGER) AS token_count, "
        "array_to_string(tokens[start + 1 : start + 512], ' ') AS chunk_text FROM chunk_starts"
    ),
    "chunk_terms": f"SELECT id, unnest({_TERMS.format('chunk_text')}) AS term FROM chunks",
    "term_counts": "SELECT id, term, count(*) AS tf FROM chunk_terms GROUP BY id, term",
    "term_idf": (
        "SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM chunks)) / (count(*) + 1.0::DOUBLE)) "
        "+ 1.0::DOUBLE AS idf FROM term_counts GROUP BY term"
    ),
    "term_weights": (
        "SELECT id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS weight "
        "FROM term_counts JOIN term_idf USING (term)"
    ),
    "judged": (
        "SELECT c.*, coalesce(l.quality = 1, false) AS relevant FROM explanation_chunks c "
        "LEFT JOIN labels l ON l.doc_id = CAST(split_part(c.document_id, '-', 2) AS BIGINT)"
    ),
    "panel": (
        "SELECT explanation_id, evaluator_id, max(factual_accuracy) AS score "
        "FROM assessments GROUP BY explanation_id, evaluator_id"
    ),
    "rated_pairs": (
        "SELECT x.evaluator_id AS rater_a, y.evaluator_id AS rater_b, x.score AS a, y.score AS b "
        "FROM panel x JOIN panel y ON x.explanation_id = y.explanation_id "
        "AND x.evaluator_id < y.evaluator_id"
    ),
    "scored_applicants": (
        "SELECT a.person_gender, a.loan_status AS y, p.approval_probability, "
        "CAST(p.predicted_outcome = 'approved' AS INTEGER) AS p "
        "FROM applicants a JOIN predictions p ON p.applicant_id = a.id"
    ),
    "fairness": (
        "SELECT person_gender, count(*) AS rows, avg(p) AS selection_rate, "
        "count(*) FILTER (y = 1 AND p = 1) / nullif(count(*) FILTER (y = 1), 0) AS true_positive_rate, "
        "count(*) FILTER (y = 0 AND p = 1) / nullif(count(*) FILTER (y = 0), 0) AS false_positive_rate "
        "FROM scored_applicants WHERE person_gender IS NOT NULL AND y IS NOT NULL GROUP BY person_gender"
    ),
}


def building_blocks(select: str) -> str:
    """Prefix a select with the blocks it needs, in order."""
    names = list(_BLOCKS)
    needed: set[str] = set()
    pending = [select]
    while pending:
        text = pending.pop()
        for name in names:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                pending.append(_BLOCKS[name])
    blocks = ",\n".join(f"{name} AS ({_BLOCKS[name]})" for name in names if name in needed)
    return f"WITH {blocks}\n{select}" if blocks else select


def _r6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


_CLEAN_NUMBERS = _r6(*_RAW_NUMBERS)
_CLEAN_OTHERS = (
    "person_gender, person_education, person_home_ownership, loan_intent, "
    "previous_loan_defaults_on_file, loan_status"
)
_DERIVED_DOUBLES = _r6(
    *_RATIOS,
    "monthly_loan_burden",
    "monthly_income",
    "loan_per_age",
    "score_per_history_year",
    "composite_risk_score",
    "stability_income_interaction",
)
_DERIVED_OTHERS = (
    "young_inexperienced, credit_score_tier, thin_credit_file, credit_risk_interaction, "
    "income_bucket, high_loan_burden_flag, employment_stability, is_high_risk, "
    "homeownership_score, intent_risk_score, pipeline_version"
)
_APPLICANT_COLUMNS = (
    "person_age, person_gender, person_education, person_income, person_emp_exp, "
    "person_home_ownership, loan_amnt, loan_intent, loan_int_rate, loan_percent_income, "
    "cb_person_cred_hist_length, credit_score, previous_loan_defaults_on_file, loan_status, source_split"
)
_FEATURE_COLUMNS = (
    "debt_to_income_ratio, loan_to_income_ratio, credit_history_to_age_ratio, affordability_ratio, "
    "monthly_loan_burden, monthly_income, emp_to_age_ratio, loan_per_age, young_inexperienced, "
    "credit_score_tier, thin_credit_file, score_per_history_year, credit_risk_interaction, "
    "income_bucket, high_loan_burden_flag, employment_stability, is_high_risk, composite_risk_score, "
    "homeownership_score, stability_income_interaction, intent_risk_score, pipeline_version"
)
_MODEL_COLUMNS = "id, algorithm, is_from_scratch, cv_accuracy, is_champion"


def _value_counts(column: str) -> str:
    return (
        f"SELECT {column}, count(*) AS count FROM features WHERE {column} IS NOT NULL GROUP BY {column}"
    )


def _duplicates(table: str, keys: str) -> str:
    return f"SELECT {keys}, count(*) AS row_count FROM {table} GROUP BY {keys} HAVING count(*) > 1"


def _orphans(child: str, column: str, parent: str) -> str:
    return (
        f"SELECT {column}, count(*) AS row_count FROM {child} c WHERE {column} IS NOT NULL "
        f"AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.id = c.{column}) GROUP BY {column}"
    )


_RULES = {
    "person_age: required": "person_age IS NULL",
    "person_home_ownership: required": "person_home_ownership IS NULL",
    "loan_intent: required": "loan_intent IS NULL",
}
_REJECTS = " UNION ALL ".join(
    f"SELECT row_no, '{rule}' AS rule FROM typed_batch WHERE {condition}"
    for rule, condition in _RULES.items()
)


def _question_score(query_id: str, text: str) -> str:
    terms = _TERMS.format("'" + text.replace("'", "''") + "'")
    return (
        f"SELECT '{query_id}' AS query_id, id, "
        f"sum(weight) / sqrt(len(list_distinct({terms}))) AS score "
        f"FROM term_weights WHERE list_contains({terms}, term) GROUP BY id"
    )


def _vector_score(query_id: str, vector: list[float]) -> str:
    fixed = "[" + ", ".join(f"{x!r}::DOUBLE" for x in vector) + "]"
    return (
        f"SELECT '{query_id}' AS query_id, vec_id, "
        f"list_cosine_similarity(CAST(embedding AS DOUBLE[]), {fixed}) AS score FROM embeddings"
    )


def _top_k(scores: list[str], key: str, condition: str = "true") -> str:
    # Engines add in different orders, so equal scores may differ beyond the twelfth decimal.
    return (
        f"SELECT query_id, {key}, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id "
        f"ORDER BY round(score, 12) DESC, {key}) AS INTEGER) AS rank FROM ({' UNION ALL '.join(scores)}) s "
        f"WHERE {condition} QUALIFY rank <= 5"
    )


_SELECTS = {
    "clean_loans": f"SELECT row_no, {_CLEAN_NUMBERS}, {_CLEAN_OTHERS} FROM clean",
    "age_outliers": (
        f"SELECT count(*) FILTER ({_number('person_age')} > 100) AS age_outliers FROM loan_raw"
    ),
    "financial_ratios": "SELECT row_no, "
    + _r6(
        "monthly_income",
        "debt_to_income_ratio",
        "loan_to_income_ratio",
        "monthly_loan_burden",
        "affordability_ratio",
        "credit_history_to_age_ratio",
    )
    + " FROM local_features",
    "age_employment": (
        f"SELECT row_no, {_r6('emp_to_age_ratio', 'loan_per_age')}, young_inexperienced FROM local_features"
    ),
    "credit_quality": (
        f"SELECT row_no, credit_score_tier, thin_credit_file, {_r6('score_per_history_year')}, "
        "credit_risk_interaction FROM local_features"
    ),
    "income_burden": "SELECT row_no, income_bucket, high_loan_burden_flag FROM local_features",
    "employment_stability": "SELECT row_no, employment_stability FROM local_features",
    "homeownership": (
        "SELECT row_no, homeownership_score, stability_income_interaction FROM scored"
    ),
    "intent_risk": "SELECT row_no, intent_risk_score FROM local_features",
    "risk_score": (
        "SELECT row_no, credit_risk_interaction, composite_risk_score, is_high_risk FROM features"
    ),
    "risk_baseline": (
        "SELECT (SELECT median(loan_int_rate) FROM clean) AS median_rate, "
        "(SELECT median(credit_score) FROM clean) AS median_score, "
        f"(SELECT round(quantile_cont(composite_risk_score, {_d(0.75)}), 6) FROM scored) AS risk_threshold"
    ),
    "feature_table": (
        f"SELECT row_no, {_CLEAN_NUMBERS}, {_CLEAN_OTHERS}, {_DERIVED_DOUBLES}, {_DERIVED_OTHERS} FROM features"
    ),
    "csv_clean_loans": f"SELECT {_CLEAN_NUMBERS}, {_CLEAN_OTHERS} FROM clean",
    "csv_feature_table": (
        f"SELECT {_CLEAN_NUMBERS}, {_CLEAN_OTHERS}, {_DERIVED_DOUBLES}, {_DERIVED_OTHERS} FROM features"
    ),
    "csv_row_numbers": (
        "SELECT row_no AS loan_no, row_number() OVER (ORDER BY row_no) - 1 AS row_no FROM loan_raw"
    ),
    "store_loaded_applicants": f"SELECT {_ID} AS id, {_APPLICANT_COLUMNS} FROM first_rows",
    "store_loaded_features": f"SELECT {_ID} AS applicant_id, {_FEATURE_COLUMNS} FROM first_rows",
    "store_load_results": (
        "SELECT batch_id, total, CASE WHEN batch_id = 'second' THEN 0 ELSE firsts END AS inserted, "
        "total - rejected - inserted AS skipped, rejected FROM "
        "(SELECT unnest(['dry', 'first', 'second']) AS batch_id, (SELECT count(*) FROM typed_batch) AS total, "
        "(SELECT count(*) FROM first_rows) AS firsts, "
        f"(SELECT count(*) FROM typed_batch WHERE NOT ({_STORABLE})) AS rejected) r"
    ),
    "store_appended_models": (
        "SELECT id, algorithm, is_from_scratch, cv_accuracy, false AS is_champion FROM models WHERE algorithm <> 'svm'"
    ),
    "store_appended_features": f"SELECT id AS applicant_id, {_FEATURE_COLUMNS} FROM applicants",
    "store_appended_predictions": (
        "SELECT p.id, p.applicant_id, p.model_id, p.predicted_outcome, p.approval_probability FROM predictions p "
        "JOIN applicants a ON a.id = p.applicant_id JOIN models m ON m.id = p.model_id WHERE m.algorithm <> 'svm'"
    ),
    "store_appended_explanations": (
        "SELECT e.id, e.prediction_id, CASE WHEN e.retriever_type = 'vector' THEN 'vector' ELSE 'tfidf' END AS retriever_type, "
        "CAST(e.retrieval_k AS INTEGER) AS retrieval_k, e.llm_response, e.generation_latency_ms FROM explanations e "
        "JOIN predictions p ON p.id = e.prediction_id WHERE e.llm_response IS NOT NULL AND p.approval_probability < 0.1"
    ),
    "store_created_tables": (
        "SELECT table_name, CASE WHEN table_name IN ('loan_applicants', 'engineered_features') THEN (SELECT count(*) FROM applicants) "
        "ELSE 0 END AS row_count FROM (SELECT unnest(['loan_applicants', 'engineered_features', 'ml_models', 'model_predictions', "
        "'retrieval_documents', 'rag_explanations', 'rag_explanation_chunks', 'evaluator_assessments']) AS table_name) t"
    ),
    "processed_feature_scan": (
        "SELECT row_no AS loan_no, row_number() OVER (ORDER BY row_no) - 1 AS row_no, round(person_income, 6) AS person_income, "
        "credit_score_tier FROM features"
    ),
    "stream_loaded_applicants": (
        f"SELECT {_ID} AS id, {_APPLICANT_COLUMNS} FROM (SELECT * FROM typed_batch WHERE {_STORABLE} QUALIFY row_number() OVER ("
        f"PARTITION BY {_KEYS} ORDER BY CASE WHEN row_no >= 4503599627370496 THEN 2 ELSE row_no % 2 END, row_no) = 1) f"
    ),
    "feature_summary": (
        "SELECT count(*) AS row_count, 36::INTEGER AS column_count, "
        "CAST(sum(CAST(is_high_risk AS INTEGER)) AS BIGINT) AS high_risk_rows, "
        "round(avg(CAST(is_high_risk AS DOUBLE)), 6) AS high_risk_share, "
        "sum(CAST(loan_status AS DOUBLE)) AS approved_rows, "
        "round(avg(CAST(loan_status AS DOUBLE)), 6) AS approved_share FROM features"
    ),
    "value_counts_income_bucket": _value_counts("income_bucket"),
    "value_counts_credit_score_tier": _value_counts("credit_score_tier"),
    "value_counts_employment_stability": _value_counts("employment_stability"),
    "summary_counts": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS count FROM features GROUP BY {c}"
        for c in ("income_bucket", "credit_score_tier", "employment_stability")
    ),
    "coerce_applicant": (
        f"SELECT row_no, {_APPLICANT_COLUMNS}, CAST(NULL AS VARCHAR) AS loan_grade FROM typed"
    ),
    "coerce_features": f"SELECT row_no, {_FEATURE_COLUMNS} FROM typed",
    "load_fingerprints": f"SELECT DISTINCT {_KEYS} FROM existing",
    "load_dedup": f"SELECT row_no, {_KEYS} FROM first_rows",
    "load_new_rows": (
        f"SELECT row_no, {_APPLICANT_COLUMNS}, {_FEATURE_COLUMNS}, {_ID} AS applicant_id FROM new_rows"
    ),
    "load_counters": (
        "SELECT (SELECT count(*) FROM typed_batch) AS incoming, "
        f"(SELECT count(*) FROM typed_batch WHERE NOT ({_STORABLE})) AS rejected, "
        f"(SELECT count(*) FROM typed_batch WHERE {_STORABLE}) - (SELECT count(*) FROM first_rows) "
        "AS skipped_in_batch, "
        "(SELECT count(*) FROM first_rows) - (SELECT count(*) FROM new_rows) AS skipped_stored, "
        "(SELECT count(*) FROM new_rows) AS inserted"
    ),
    "load_chunk_counters": (
        "SELECT row_no // 500 AS chunk_no, count(*) AS total, "
        f"count(*) FILTER (NOT ({_STORABLE})) AS rejected, "
        "count(*) FILTER (row_no IN (SELECT row_no FROM new_rows)) AS inserted, "
        "count(*) - rejected - inserted AS skipped FROM typed_batch GROUP BY row_no // 500"
    ),
    "load_rejects": _REJECTS,
    "dq_not_null": " UNION ALL ".join(
        f"SELECT '{rule.split(':')[0]}' AS column_name, count(*) AS missing FROM typed_batch WHERE {condition} "
        "HAVING count(*) > 0"
        for rule, condition in _RULES.items()
    ),
    "dq_rules": f"SELECT rule, count(*) AS row_count FROM ({_REJECTS}) r GROUP BY rule",
    "dq_table_rules": (
        "SELECT table_name, rule, count(*) AS row_count FROM ("
        "SELECT 'ml_models' AS table_name, 'algorithm: not in domain' AS rule FROM models WHERE algorithm = 'svm' "
        "UNION ALL SELECT 'ml_models', 'trained_at: required' FROM models WHERE trained_at IS NULL "
        "UNION ALL SELECT 'ml_models', 'is_champion: required' FROM models WHERE false "
        "UNION ALL SELECT 'model_predictions', 'predicted_outcome: not in domain' FROM predictions WHERE model_id = 'model-7' "
        "UNION ALL SELECT 'model_predictions', 'risk_tier: too long' FROM predictions WHERE model_id = 'model-8' "
        "UNION ALL SELECT 'loan_applicants', unnest(list_filter([CASE WHEN person_age IS NULL THEN 'person_age: required' END, "
        "CASE WHEN person_income IS NULL THEN 'person_income: required' END, CASE WHEN loan_amnt IS NULL THEN 'loan_amnt: required' END, "
        "CASE WHEN person_home_ownership IS NULL THEN 'person_home_ownership: required' END, CASE WHEN loan_intent IS NULL THEN "
        "'loan_intent: required' END, CASE WHEN credit_score < 400 THEN 'loan_grade: not in domain' END], lambda r: r IS NOT NULL)) FROM typed_batch "
        "UNION ALL SELECT 'engineered_features', 'credit_score_tier: not in domain' FROM typed_batch WHERE credit_score > 800 "
        "UNION ALL SELECT 'retrieval_documents', 'source_name: too long' FROM chunks WHERE chunk_index % 3 = 2 "
        "UNION ALL SELECT 'rag_explanation_chunks', 'rank: required' FROM explanation_chunks WHERE rank = 5 "
        "UNION ALL SELECT 'rag_explanations', 'llm_response: required' FROM explanations WHERE llm_response IS NULL "
        "UNION ALL SELECT 'evaluator_assessments', 'evaluator_id: too long' FROM long_evaluators WHERE length(evaluator_id) > 50 "
        "UNION ALL SELECT 'evaluator_assessments', 'policy_traceability: out of range' FROM assessments "
        "WHERE policy_traceability NOT BETWEEN 1 AND 5) v GROUP BY table_name, rule"
    ),
    "dq_primary_key": _duplicates("repeated_predictions", "id"),
    "dq_unique_prediction": _duplicates("repeated_predictions", "applicant_id, model_id"),
    "dq_unique_assessment": _duplicates("repeated_assessments", "explanation_id, evaluator_id"),
    "dq_orphan_features": (
        "SELECT a.id AS applicant_id, count(*) AS row_count FROM applicants a WHERE a.id NOT IN "
        f"(SELECT {_ID} FROM existing) GROUP BY a.id"
    ),
    "dq_orphan_prediction_applicants": _orphans("predictions", "applicant_id", "applicants"),
    "dq_orphan_prediction_models": _orphans(
        "predictions", "model_id", "(SELECT * FROM models WHERE NOT is_champion)"
    ),
    "dq_orphan_explanations": _orphans(
        "explanations", "prediction_id", "(SELECT * FROM predictions WHERE approval_probability >= 0.1)"
    ),
    "dq_orphan_chunk_explanations": _orphans(
        "explanation_chunks", "explanation_id", "(SELECT * FROM explanations WHERE llm_response IS NOT NULL)"
    ),
    "dq_orphan_chunk_documents": _orphans("explanation_chunks", "document_id", "chunks"),
    "dq_orphan_assessments": _orphans(
        "assessments", "explanation_id", "(SELECT * FROM explanations WHERE llm_response IS NOT NULL)"
    ),
    "dq_enum_domain": (
        "SELECT algorithm, count(*) AS row_count FROM models WHERE algorithm NOT IN "
        "('logistic_regression', 'decision_tree', 'random_forest', 'gradient_boosting', 'naive_bayes') "
        "GROUP BY algorithm"
    ),
    "dq_decimal_range": (
        "SELECT row_no, round(loan_percent_income * 16, 6) AS loan_percent_income FROM features "
        "WHERE TRY_CAST(loan_percent_income * 16 AS DECIMAL(5,4)) IS NULL AND loan_percent_income IS NOT NULL"
    ),
    "dq_string_length": "SELECT id FROM long_evaluators WHERE length(evaluator_id) > 50",
    "dq_likert": (
        "SELECT id, policy_traceability, factual_accuracy, completeness, actionability FROM assessments "
        "WHERE policy_traceability NOT BETWEEN 1 AND 5 OR factual_accuracy NOT BETWEEN 1 AND 5 "
        "OR completeness NOT BETWEEN 1 AND 5 OR actionability NOT BETWEEN 1 AND 5"
    ),
    "dq_champion": (
        "SELECT count(*) FILTER (is_champion) AS champions, "
        "count(*) FILTER (is_champion) <= 1 AS at_most_one FROM models"
    ),
    "lookup_applicant": (
        f"SELECT id, {_APPLICANT_COLUMNS} FROM applicants WHERE id = (SELECT min(id) FROM applicants)"
    ),
    "lookup_features": (
        f"SELECT id AS applicant_id, {_FEATURE_COLUMNS} FROM applicants "
        "WHERE id = (SELECT min(id) FROM applicants)"
    ),
    "lookup_model": f"SELECT {_MODEL_COLUMNS} FROM models WHERE id = 'model-7'",
    "lookup_prediction": "SELECT * FROM predictions WHERE id = (SELECT min(id) FROM predictions)",
    "lookup_explanation": (
        "SELECT * FROM explanations WHERE prediction_id = (SELECT min(prediction_id) FROM explanations) LIMIT 1"
    ),
    "lookup_applicant_predictions": (
        "SELECT * FROM predictions WHERE applicant_id = (SELECT min(applicant_id) FROM predictions)"
    ),
    "lookup_approved_predictions": (
        "SELECT * FROM predictions WHERE applicant_id IN (SELECT id FROM applicants WHERE loan_status = 1)"
    ),
    "champion_model": (
        f"SELECT {_MODEL_COLUMNS} FROM models WHERE is_champion "
        "ORDER BY trained_at DESC NULLS LAST, id LIMIT 1"
    ),
    "list_applicants": f"SELECT id, {_APPLICANT_COLUMNS} FROM applicants ORDER BY id LIMIT 100",
    "list_models": f"SELECT {_MODEL_COLUMNS} FROM models ORDER BY id LIMIT 10",
    "join_applicant_features": (
        f"SELECT a.id AS applicant_id, {_APPLICANT_COLUMNS}, "
        + ", ".join(
            f"CASE WHEN loan_status = 1 THEN {c.strip()} END AS {c.strip()}"
            for c in _FEATURE_COLUMNS.split(",")
        )
        + " FROM applicants a"
    ),
    "join_applicant_predictions": (
        "SELECT p.applicant_id, p.id AS prediction_id, p.model_id, p.predicted_outcome, "
        "p.approval_probability, a.person_income, a.loan_amnt, a.loan_status "
        "FROM predictions p JOIN applicants a ON p.applicant_id = a.id"
    ),
    "join_model_predictions": (
        "SELECT p.applicant_id, p.id AS prediction_id, p.model_id, p.predicted_outcome, "
        "p.approval_probability, m.algorithm, m.is_from_scratch, m.cv_accuracy, m.is_champion "
        "FROM predictions p JOIN models m ON p.model_id = m.id"
    ),
    "join_prediction_explanations": (
        "SELECT p.id AS prediction_id, p.model_id, p.approval_probability, e.id AS explanation_id, "
        "e.retriever_type, e.retrieval_k, e.llm_response, e.generation_latency_ms "
        "FROM predictions p LEFT JOIN explanations e ON e.prediction_id = p.id"
    ),
    "join_explanation_documents": (
        "SELECT c.explanation_id, c.document_id, c.rank, c.retrieval_score, e.retriever_type, "
        "d.source_name, d.chunk_index, d.token_count FROM explanation_chunks c "
        "JOIN explanations e ON e.id = c.explanation_id JOIN chunks d ON d.id = c.document_id"
    ),
    "join_explanation_assessments": (
        "SELECT a.explanation_id, a.id AS assessment_id, a.evaluator_id, a.is_rag_system, "
        "a.policy_traceability, a.factual_accuracy, a.completeness, a.actionability, e.retriever_type "
        "FROM assessments a JOIN explanations e ON e.id = a.explanation_id"
    ),
    "chunk_documents": "SELECT id, source_name, chunk_index, token_count, chunk_text FROM chunks",
    "tfidf_vectors": "SELECT id, term, round(weight, 6) AS weight FROM term_weights",
    "tfidf_topk": _top_k([_question_score(*q) for q in QUESTIONS.items()], "id", "score > 0"),
    "vector_topk": _top_k([_vector_score(*v) for v in VECTORS.items()], "vec_id"),
    "retrieval_score_maps": (
        "SELECT explanation_id, document_id, CAST(max(retrieval_score) AS DOUBLE) AS retrieval_score "
        "FROM explanation_chunks GROUP BY explanation_id, document_id"
    ),
    "precision_at_k": (
        "SELECT explanation_id, round(count(*) FILTER (relevant) / 5.0::DOUBLE, 6) AS precision_at_k "
        "FROM judged WHERE rank <= 5 GROUP BY explanation_id"
    ),
    "mean_reciprocal_rank": (
        "SELECT count(*) AS queries, round(avg(reciprocal), 6) AS mrr FROM (SELECT explanation_id, "
        "coalesce(1.0::DOUBLE / min(rank) FILTER (relevant), 0.0::DOUBLE) AS reciprocal "
        "FROM judged GROUP BY explanation_id) r"
    ),
    "cohen_kappa": (
        "SELECT t.rater_a, t.rater_b, t.items, round((t.agreed / t.items - c.chance) "
        "/ nullif(1 - c.chance, 0), 6) AS kappa FROM "
        "(SELECT rater_a, rater_b, count(*) AS items, count(*) FILTER (a = b) AS agreed "
        "FROM rated_pairs GROUP BY rater_a, rater_b) t JOIN "
        "(SELECT x.rater_a, x.rater_b, sum(x.n * y.n) / (any_value(x.total) * any_value(x.total)) AS chance "
        "FROM (SELECT rater_a, rater_b, a AS score, CAST(count(*) AS DOUBLE) AS n, "
        "sum(count(*)) OVER (PARTITION BY rater_a, rater_b) AS total "
        "FROM rated_pairs GROUP BY rater_a, rater_b, a) x "
        "JOIN (SELECT rater_a, rater_b, b AS score, CAST(count(*) AS DOUBLE) AS n "
        "FROM rated_pairs GROUP BY rater_a, rater_b, b) y USING (rater_a, rater_b, score) "
        "GROUP BY x.rater_a, x.rater_b) c USING (rater_a, rater_b)"
    ),
    "rubric_means": (
        "SELECT is_rag_system, count(*) AS assessments, "
        + ", ".join(
            f"round(avg({c}), 6) AS {c}"
            for c in ("policy_traceability", "factual_accuracy", "completeness", "actionability")
        )
        + " FROM assessments GROUP BY is_rag_system"
    ),
    "classification_metrics": (
        "SELECT rows, round((tp + tn) / rows, 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, "
        "round(tp / nullif(tp + fn, 0), 6) AS recall, "
        "round((2 * tp / (2 * tp + fp + fn) * (tp + fn) + 2 * tn / (2 * tn + fp + fn) * (tn + fp)) / rows, 6) "
        "AS f1_weighted FROM (SELECT count(*) AS rows, count(*) FILTER (y = 1 AND p = 1) AS tp, "
        "count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, "
        "count(*) FILTER (y = 0 AND p = 0) AS tn FROM scored_applicants "
        "WHERE y IS NOT NULL AND p IS NOT NULL) t"
    ),
    "roc_auc": (
        "SELECT round((sum(avg_rank) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) "
        "/ (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM (SELECT y, "
        "CAST(rank() OVER (ORDER BY approval_probability) AS DOUBLE) + "
        "(count(*) OVER (PARTITION BY approval_probability) - 1) / 2.0::DOUBLE AS avg_rank "
        "FROM scored_applicants WHERE y IS NOT NULL) r"
    ),
    "fairness_by_group": (
        f"SELECT person_gender, rows, {_r6('selection_rate', 'true_positive_rate', 'false_positive_rate')} "
        "FROM fairness"
    ),
    "fairness_gaps": (
        "SELECT round(max(selection_rate) - min(selection_rate), 6) AS demographic_parity, "
        "round(greatest(max(true_positive_rate) - min(true_positive_rate), "
        "max(false_positive_rate) - min(false_positive_rate)), 6) AS equalized_odds FROM fairness"
    ),
    "decision_actions": (
        "SELECT row_no, CASE WHEN s >= 0.8::DOUBLE THEN 'high' WHEN s >= 0.5::DOUBLE THEN 'medium' "
        "WHEN s IS NOT NULL THEN 'low' END AS risk_tier, "
        "CASE WHEN s >= 0.8::DOUBLE THEN 'immediate_retention_offer' WHEN s >= 0.5::DOUBLE "
        "THEN 'engagement_campaign' WHEN s IS NOT NULL THEN 'monitor_only' END AS action "
        "FROM (SELECT row_no, composite_risk_score AS s FROM features) f"
    ),
    "top_attributions": (
        "SELECT row_no, coalesce(string_agg(name, ',' ORDER BY weight DESC, name) FILTER (weight IS NOT NULL), '') "
        "AS top_shap_features FROM ("
        "SELECT row_no, name, abs(value) AS weight, row_number() OVER (PARTITION BY row_no "
        "ORDER BY abs(value) DESC NULLS LAST, name) AS place FROM (SELECT row_no, "
        "unnest(['emp_to_age_ratio', 'affordability_ratio', 'debt_to_income_ratio', 'composite_risk_score']) AS name, "
        "unnest([emp_to_age_ratio * 2, -affordability_ratio, debt_to_income_ratio, composite_risk_score]) AS value "
        "FROM features) v) ranked "
        "WHERE place <= 3 GROUP BY row_no"
    ),
    "splits_and_folds": (
        "SELECT row_no, CASE WHEN h % 10000 < 2000 THEN 'test' WHEN h % 10000 < 3000 THEN 'validation' "
        "ELSE 'train' END AS source_split, CAST(f % 5 AS INTEGER) AS fold FROM (SELECT row_no, "
        "CAST(concat('0x', substr(md5(concat('split|42|', row_no)), 1, 8)) AS BIGINT) AS h, "
        "CAST(concat('0x', substr(md5(concat('fold|42|', row_no)), 1, 8)) AS BIGINT) AS f FROM loan_raw) r"
    ),
    "phrase_flags": (
        "SELECT id, concat_ws(',', CASE WHEN contains(t, 'guaranteed') THEN 'guaranteed' END, "
        "CASE WHEN contains(t, '100% sure') THEN '100% sure' END, CASE WHEN contains(t, 'no risk') THEN 'no risk' END) "
        "AS phrases FROM (SELECT id, lower(coalesce(llm_response, '')) AS t FROM explanations UNION ALL "
        "SELECT concat_ws('-', conv_id, turn), lower(coalesce(text, '')) FROM conversations) x"
    ),
    "confidence_flags": (
        "SELECT id, approval_probability > 0.35 AND approval_probability < 0.65 AS low_confidence FROM predictions"
    ),
    "constructed_prompts": (
        "SELECT explanation_id, md5(concat(string_agg(concat('[', rank, '] ', chunk_text), chr(10) "
        "ORDER BY rank, chunk_text), chr(10), 'Why was the loan decided so?')) AS prompt_md5 "
        "FROM explanation_chunks c JOIN chunks d ON d.id = c.document_id WHERE rank <= 3 GROUP BY explanation_id"
    ),
    "krippendorff_alpha": (
        "SELECT count(*) AS items, round(1 - sum(2 * (m * q - s * s) / (m - 1)) / "
        "(2 * (sum(m) * sum(q) - sum(s) * sum(s)) / (sum(m) - 1)), 6) AS alpha FROM (SELECT explanation_id, "
        "count(*)::DOUBLE AS m, sum(score)::DOUBLE AS s, sum(score * score)::DOUBLE AS q FROM panel "
        "GROUP BY explanation_id HAVING count(*) > 1) u"
    ),
}

ORACLES = {name: building_blocks(select) for name, select in _SELECTS.items()}
