"""Loan data derived from the driver's tables.

The driver has no loans, so raw applications are read off ``orders`` and
``customer``, predictions off ``lineitem``, models off ``supplier`` and
retrieval chunks off ``documents``. The texts run unchanged in Spark and in
DuckDB, apart from the series function passed in as ``{series}``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager, nullcontext
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditmill.operators.cleaning import clean_loans
from creditmill.operators.coercion import coerce_loans, fingerprint_id, stored_columns
from creditmill.operators.dedup import KEYS, first_occurrences
from creditmill.operators.features import fit_and_engineer, select_features
from creditmill.operators.retrieval import chunk_texts
from creditmill.plans.load import applicant_rows, feature_rows, load_features
from creditmill.session import broadcast_up_to, scratch_path, stage, staged
from creditmill.sources.store import LoanStore
from creditmill.sources.tables import APPLICANTS as APPLICANTS_TABLE
from creditmill.sources.tables import EXPLANATIONS as EXPLANATIONS_TABLE
from creditmill.sources.tables import FEATURES as FEATURES_TABLE
from creditmill.sources.tables import MODELS as MODELS_TABLE
from creditmill.sources.tables import PREDICTIONS as PREDICTIONS_TABLE
from creditmill.sources.tables import Table

LOAN_RAW = """
SELECT o_orderkey AS row_no,
  CASE WHEN o_orderkey % 997 = 1 THEN '123' WHEN o_orderkey % 991 = 1 THEN 'n/a'
       ELSE CAST(18 + (o_orderkey * 7) % 53 AS STRING) END AS person_age,
  CASE o_orderkey % 4 WHEN 0 THEN ' Male' WHEN 1 THEN 'female ' WHEN 2 THEN 'FEMALE'
       ELSE 'other' END AS person_gender,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'Doctorate' WHEN 'BUILDING' THEN 'Bachelor '
       WHEN 'AUTOMOBILE' THEN 'High School' WHEN 'FURNITURE' THEN 'Master'
       ELSE 'Associate' END AS person_education,
  CASE WHEN o_orderkey % 1009 = 1 THEN '0'
       ELSE CAST(12000 + (o_orderkey * 7919) % 140000 AS STRING) END AS person_income,
  CAST((o_orderkey * 5) % 11 AS STRING) AS person_emp_exp,
  CASE WHEN o_orderkey % 211 = 1 THEN 'LODGER' WHEN o_orderkey % 5 = 0 THEN 'rent'
       WHEN o_orderkey % 5 = 1 THEN ' MORTGAGE' WHEN o_orderkey % 5 = 2 THEN 'OWN'
       WHEN o_orderkey % 5 = 3 THEN 'OTHER' ELSE 'Rent' END AS person_home_ownership,
  CAST(500 + CAST(floor(o_totalprice) AS BIGINT) % 34500 AS STRING) AS loan_amnt,
  CASE WHEN o_orderkey % 101 = 1 THEN 'personal' WHEN o_orderkey % 223 = 1 THEN 'CRYPTO'
       WHEN o_orderkey % 13 = 1 THEN 'VENTURE'
       WHEN o_orderpriority = '1-URGENT' THEN 'MEDICAL'
       WHEN o_orderpriority = '2-HIGH' THEN 'DEBTCONSOLIDATION'
       WHEN o_orderpriority = '3-MEDIUM' THEN 'HOMEIMPROVEMENT'
       WHEN o_orderpriority = '5-LOW' THEN 'EDUCATION '
       ELSE 'PERSONAL' END AS loan_intent,
  concat(CAST(CAST(floor((500 + (o_orderkey * 37) % 1501) / 100) AS BIGINT) AS STRING), '.',
         lpad(CAST((500 + (o_orderkey * 37) % 1501) % 100 AS STRING), 2, '0')) AS loan_int_rate,
  concat('0.', lpad(CAST((o_orderkey * 31) % 67 AS STRING), 2, '0')) AS loan_percent_income,
  CAST((o_orderkey * 3) % 29 AS STRING) AS cb_person_cred_hist_length,
  CASE WHEN o_orderkey % 331 = 1 THEN '739.5'
       ELSE CAST(285 + (o_orderkey * 17) % 581 AS STRING) END AS credit_score,
  CASE WHEN o_orderkey % 887 = 1 THEN NULL WHEN o_orderkey % 89 = 1 THEN 'Maybe'
       WHEN o_orderstatus = 'F' THEN 'Yes' ELSE ' No' END AS previous_loan_defaults_on_file,
  CASE WHEN o_orderkey % 9 < 2 THEN '1' ELSE '0' END AS loan_status
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""

MODELS = """
SELECT concat('model-', CAST(s_suppkey AS STRING)) AS id,
  CASE s_suppkey % 6 WHEN 0 THEN 'logistic_regression' WHEN 1 THEN 'decision_tree'
       WHEN 2 THEN 'random_forest' WHEN 3 THEN 'gradient_boosting'
       WHEN 4 THEN 'naive_bayes' ELSE 'svm' END AS algorithm,
  s_suppkey % 2 = 0 AS is_from_scratch,
  CAST((5000 + s_suppkey * 37 % 4999) / 10000.0 AS DECIMAL(6,4)) AS cv_accuracy,
  CASE WHEN s_suppkey % 17 = 3 THEN NULL
       ELSE CAST(concat('2024-', lpad(CAST(1 + s_suppkey % 12 AS STRING), 2, '0'), '-',
                        lpad(CAST(1 + s_suppkey % 28 AS STRING), 2, '0'), ' 00:00:00')
                 AS TIMESTAMP) END AS trained_at,
  s_suppkey % 50 = 7 AS is_champion
FROM {supplier}
"""

# One prediction per application and model, from all line items of the pair.
PREDICTIONS = """
SELECT concat('prediction-', CAST(l_orderkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS id,
  coalesce(applicant_id, concat('order-', CAST(l_orderkey AS STRING))) AS applicant_id,
  concat('model-', CAST(l_suppkey AS STRING)) AS model_id,
  CASE WHEN base % 10001 >= 5000 THEN 'approved' ELSE 'rejected' END AS predicted_outcome,
  CAST(base % 10001 / 10000.0 AS DECIMAL(6,4)) AS approval_probability
FROM (
  SELECT l_orderkey, l_suppkey, l_orderkey * 13 + CAST(sum(l_linenumber) AS BIGINT) * 101 AS base
  FROM {lineitem} GROUP BY l_orderkey, l_suppkey
) AS pairs LEFT JOIN {applicant_keys} ON l_orderkey = row_no
"""

EXPLANATIONS = """
SELECT concat('explanation-', CAST(l_orderkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS id,
  concat('prediction-', CAST(l_orderkey AS STRING), '-', CAST(l_suppkey AS STRING))
    AS prediction_id,
  CASE WHEN l_orderkey % 3 = 0 THEN 'vector' ELSE 'tfidf' END AS retriever_type,
  5 AS retrieval_k,
  CASE WHEN l_orderkey % 23 = 4 THEN 'Approval is GUARANTEED at this income.'
       WHEN l_orderkey % 37 = 5 THEN 'There is no risk; we are 100% sure.'
       WHEN l_orderkey % 401 = 6 THEN NULL
       ELSE 'The loan was decided on stable income and credit score.' END AS llm_response,
  CAST(80 + l_orderkey % 200 AS INT) AS generation_latency_ms
FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM {lineitem}) AS pairs
"""

# A chunk has 448 new words, so a text of 3,000 characters more has at least about one chunk more.
EXPLANATION_CHUNKS = """
SELECT concat(explanation_id, '-', CAST(rank AS STRING)) AS id, explanation_id,
  concat('document-', CAST(document AS STRING), '-',
         CAST(picked % (1 + CAST(floor(coalesce(n_chars, 0) / 3000) AS BIGINT)) AS STRING)) AS document_id,
  rank,
  CAST((10000 - rank * 1500 - picked % 997) / 10000.0 AS DECIMAL(8,6)) AS retrieval_score
FROM (
  SELECT *, picked % (CAST(document_count AS BIGINT) + 1) AS document FROM (
    SELECT concat('explanation-', CAST(l_orderkey AS STRING), '-', CAST(l_suppkey AS STRING))
             AS explanation_id,
      CAST(rank AS INT) AS rank,
      CASE WHEN l_orderkey % 3 = 1 AND rank = 1 THEN 0
           ELSE l_orderkey * 7 + l_suppkey * 31 + rank * 13 END AS picked,
      (SELECT count(*) FROM {documents}) AS document_count
    FROM (SELECT l_orderkey, l_suppkey, {series} AS rank
          FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM {lineitem}) AS pairs) AS ranked
  ) AS numbered
) AS chosen LEFT JOIN {texts} ON doc_id = document
"""

ASSESSMENTS = """
SELECT concat(explanation_id, '-', CAST(evaluator AS STRING)) AS id, explanation_id,
  concat('evaluator_', CAST(evaluator AS STRING)) AS evaluator_id,
  base % 2 = 0 AS is_rag_system,
  CAST(CASE WHEN base % 499 = 1 THEN 6 ELSE 1 + (base + shift) % 5 END AS INT)
    AS policy_traceability,
  CAST(1 + (base * 3 + shift) % 5 AS INT) AS factual_accuracy,
  CAST(1 + (base * 7 + evaluator) % 5 AS INT) AS completeness,
  CAST(1 + (base + evaluator * evaluator) % 5 AS INT) AS actionability
FROM (
  SELECT concat('explanation-', CAST(l_orderkey AS STRING), '-', CAST(l_suppkey AS STRING))
           AS explanation_id,
    CAST(evaluator AS INT) AS evaluator,
    l_orderkey * 2 + l_suppkey AS base,
    CASE WHEN (l_orderkey + evaluator * 5) % 7 < 2 THEN 1 ELSE 0 END AS shift
  FROM (SELECT l_orderkey, l_suppkey, {series3} AS evaluator
        FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM {lineitem}) AS pairs) AS panel
) AS rated
"""

# The same tables with violations put in, for the checks that look for them.
REPEATED_PREDICTIONS = """
SELECT * FROM {predictions} UNION ALL
SELECT * FROM {predictions} WHERE model_id IN ('model-7', 'model-8')
"""

REPEATED_ASSESSMENTS = """
SELECT * FROM {assessments} UNION ALL
SELECT * FROM {assessments} WHERE completeness = 5 AND evaluator_id = 'evaluator_2'
"""

LONG_EVALUATORS = """
SELECT id, CASE WHEN completeness = 5 THEN repeat(evaluator_id, 6) ELSE evaluator_id END AS evaluator_id
FROM {assessments}
"""


_WRITTEN: dict[tuple[str, str, str], DataFrame] = {}
_STORES: dict[tuple[str, str, str], LoanStore] = {}


#: Line items of one part of their pairs, each of which becomes up to five rows of text keys.
PAIR_PART = 1_000_000
#: Line items of one slice of explanations, whose texts are brought together at a time.
SLICE = 2_000_000
#: The same where only links without texts are moved.
LINK_SLICE = 10_000_000
#: Documents whose lengths are broadcast, counted first; beyond it the join is left to the optimizer.
BROADCAST_TEXTS = 4_000_000
#: Row numbers of copies lie beyond those of all orders, whatever the scale factor.
COPY_OFFSET = 1 << 52


class Samples:
    """Derived frames of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, text: str, **frames: DataFrame) -> DataFrame:
        text = text.replace("{series}", "explode(sequence(1, 5))")
        text = text.replace("{series3}", "explode(sequence(1, 3))")
        for name in frames:
            text = text.replace("{%s}" % name, "{%s} AS %s" % (name, name))
        return self.spark.sql(text, **frames)

    def loan_raw(self) -> DataFrame:
        return self._sql(
            LOAN_RAW, orders=self.table("orders"), customer=self.table("customer")
        )

    def features(self) -> DataFrame:
        """The feature table as a written table, which is what the load starts from."""
        return self._once("features", self._features)

    @contextmanager
    def _features(self) -> Iterator[DataFrame]:
        """As ``run_features`` has it: the passes read columns of cleaned rows, which are derived once."""
        with staged(clean_loans(self.loan_raw()), "cleaned-loans") as cleaned:
            yield select_features(fit_and_engineer(cleaned), ("row_no",))

    def _once(self, name: str, make: Callable[[], AbstractContextManager[DataFrame]]) -> DataFrame:
        """A derived table, written once per application and scale factor."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _WRITTEN:
            with make() as rows:
                _WRITTEN[key] = stage(rows, f"sample-{name}")
        return _WRITTEN[key]

    def store(self, table: Table) -> LoanStore:
        """A store with the published rows of one table, so that a lookup waits for no other."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, table.name)
        if key not in _STORES:
            store = LoanStore(self.spark, scratch_path(self.spark, "sample-store"))
            rows = self._rows_of(table)
            known = [F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in table.columns]
            store.publish("samples", {table.name: store.write(table.name, rows.select(*known), "samples")})
            _STORES[key] = store
        return _STORES[key]

    def _rows_of(self, table: Table) -> DataFrame:
        """Applicants and features as a load stores them, the others as they are."""
        if table in (APPLICANTS_TABLE, FEATURES_TABLE):
            rows = self._first_applications().withColumn("applicant_id", fingerprint_id())
            stored = applicant_rows if table is APPLICANTS_TABLE else feature_rows
            return stored(rows, datetime.now(timezone.utc))
        rows = {MODELS_TABLE: self.models, PREDICTIONS_TABLE: self.predictions, EXPLANATIONS_TABLE: self.explanations}
        return rows[table]()

    def loaded_store(self) -> LoanStore:
        """A new store with one loaded batch."""
        store = LoanStore(self.spark, scratch_path(self.spark, "store"))
        load_features(self.features(), store, batch_id="loans")
        return store

    def store_with_parents(self) -> LoanStore:
        """A new store with the applicants and models that predictions refer to."""
        store = LoanStore(self.spark, scratch_path(self.spark, "store"))
        name = APPLICANTS_TABLE.name
        store.publish("loans", {name: store.write(name, self._rows_of(APPLICANTS_TABLE), "loans")})
        kept = self.models().where("algorithm <> 'svm'").drop("trained_at")
        store.create_models(kept, "models")
        return store

    def loan_batch(self) -> DataFrame:
        """Feature rows plus a later copy of every fiftieth: duplicates within the batch."""
        rows = self.features()
        copies = rows.where("row_no % 50 = 0").withColumn("row_no", F.col("row_no") + COPY_OFFSET)
        return rows.unionByName(copies)

    def loan_existing(self) -> DataFrame:
        """Stored applications: every tenth valid row, typed as the table stores it."""
        typed = coerce_loans(self.features())
        return typed.where(F.col("storable") & (F.col("row_no") % 10 == 3))

    def applicants(self) -> DataFrame:
        """Valid applications, first occurrence each, with their key and all typed columns."""

        return self._once("applicants", lambda: nullcontext(self._first_applications().withColumn("id", fingerprint_id())))

    def _first_applications(self) -> DataFrame:
        typed = coerce_loans(self.features()).where("storable")
        return first_occurrences(stored_columns(typed, "row_no"))

    def applicant_keys(self) -> DataFrame:
        """Row numbers and keys of the applicants; only fingerprints are moved for them."""
        typed = coerce_loans(self.features()).where("storable")
        return first_occurrences(typed.select("row_no", *KEYS)).select("row_no", fingerprint_id().alias("applicant_id"))

    def stored_applicants(self) -> DataFrame:
        """The applicants of ``loan_existing``, with their key."""
        return self.loan_existing().withColumn("id", fingerprint_id())

    def documents(self) -> DataFrame:
        """Retrieval documents: every text of ``documents`` in chunks."""
        texts = self.table("documents").select("doc_id", F.col("source").alias("source_name"), "text")
        chunks = chunk_texts(texts, "text")
        key = F.concat_ws("-", F.lit("document"), F.col("doc_id"), F.col("chunk_index"))
        return chunks.withColumn("id", key)

    def models(self) -> DataFrame:
        return self._sql(MODELS, supplier=self.table("supplier"))

    def _pairs(self) -> DataFrame:
        """The distinct pairs of keys of all line items, in parts that stay small when their rows are multiplied."""
        lines = self.table("lineitem")
        parts = -(-lines.count() // PAIR_PART) or 1
        keys = ["l_orderkey", "l_suppkey"]
        return lines.select(*keys).distinct().repartition(parts, *keys)

    def predictions(self) -> DataFrame:
        return self._sql(PREDICTIONS, lineitem=self.table("lineitem"), applicant_keys=self.applicant_keys())

    def explanations(self, pairs: DataFrame | None = None) -> DataFrame:
        return self._sql(EXPLANATIONS, lineitem=self._pairs() if pairs is None else pairs)

    @contextmanager
    def pair_slices(self, size: int | None = None) -> Iterator[list[DataFrame]]:
        """The pairs of keys in slices of bounded size; the pairs of one explanation, also of none, are in the same slice."""
        lines = self.table("lineitem")
        slices = -(-lines.count() // (size or SLICE)) or 1
        key = F.concat("l_orderkey", F.lit("-"), "l_suppkey")
        pairs = lines.select("l_orderkey", "l_suppkey").distinct()
        dealt = pairs.withColumn("slice", F.pmod(F.xxhash64(key), F.lit(slices)).cast("int"))
        with staged(dealt, "pairs", ("slice",)) as dealt:
            yield [dealt.where(F.col("slice") == number).drop("slice") for number in range(slices)]

    def explanation_chunks(self, pairs: DataFrame | None = None) -> DataFrame:
        """Derived anew by each query, which then evaluates the columns it needs; only pairs of keys are shuffled."""
        documents = self.table("documents")
        texts = broadcast_up_to(documents.select("doc_id", "n_chars"), BROADCAST_TEXTS)
        return self._sql(EXPLANATION_CHUNKS, lineitem=self._pairs() if pairs is None else pairs, documents=documents, texts=texts)

    def assessments(self) -> DataFrame:
        return self._sql(ASSESSMENTS, lineitem=self._pairs())

    def repeated_predictions(self) -> DataFrame:
        return self._sql(REPEATED_PREDICTIONS, predictions=self.predictions())

    def repeated_assessments(self) -> DataFrame:
        return self._sql(REPEATED_ASSESSMENTS, assessments=self.assessments())

    def long_evaluators(self) -> DataFrame:
        return self._sql(LONG_EVALUATORS, assessments=self.assessments())
