"""What a query writes and shuffles on the way to its rows."""

import math
import time

import pytest
from pyspark.sql import functions as F

from creditmill.catalog import queries, samples
from creditmill.catalog.samples import Samples
from creditmill.learning import trees
from creditmill.learning.design import Scale
from creditmill.operators import coercion, evaluation, joins, output_rules, quality, retrieval, similar_chunks
from creditmill.plans import training
from creditmill.plans.feature_table import build_feature_table
from creditmill.sources import tables


@pytest.fixture
def fresh(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(samples, "_WRITTEN", {})
    monkeypatch.setattr(samples, "_STORES", {})
    return Samples(spark, sf_dir)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def written() -> set[str]:
    return {key[2] for key in samples._WRITTEN}


def test_chunks_are_not_written_and_only_pairs_are_shuffled(fresh):
    plan = plan_of(fresh.explanation_chunks())
    assert not written() and plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert shuffles and all("explanation_id" not in line and "picked" not in line for line in shuffles)


@pytest.mark.parametrize("name", ["precision_at_k", "mean_reciprocal_rank", "retrieval_score_maps", "dq_orphan_chunk_documents"])
def test_chunk_queries_write_no_table(fresh, name):
    queries.QUERIES[name](fresh)
    assert not written()


def test_labels_of_a_document_count_as_often_as_they_occur(fresh, spark, monkeypatch):
    chunks = spark.createDataFrame([("e", "document-1-0", 1), ("e", "document-2-0", 2), ("f", "document-3-0", 1)], "explanation_id string, document_id string, rank int")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, None)], "doc_id bigint, quality int")
    monkeypatch.setattr(fresh, "explanation_chunks", lambda: chunks)
    monkeypatch.setattr(fresh, "table", lambda name: labels)
    found = {r["explanation_id"]: r["precision_at_k"] for r in queries.precision_at_k(fresh).collect()}
    assert found == {"e": 0.4, "f": 0.0}
    assert "SortMergeJoin" not in plan_of(queries.precision_at_k(fresh))


def test_score_maps_shuffle_once(spark):
    chunks = spark.createDataFrame([("e", "d", 0.5), ("e", "d", 0.7), ("e", "c", 0.1)], "explanation_id string, document_id string, retrieval_score double")
    found = retrieval.retrieval_scores(chunks)
    assert found.first()["retrieval_scores"] == {"d": 0.7, "c": 0.1}
    assert plan_of(found).count("Exchange") == 1


def test_ratings_shuffle_once_by_item(spark):
    ratings = spark.createDataFrame([("i", "a", 1), ("i", "b", 2), ("j", "a", 3), ("j", "b", 3)], "explanation_id string, evaluator_id string, x int")
    plan = plan_of(evaluation.krippendorff_alpha(ratings, "explanation_id", "evaluator_id", "x"))
    assert plan.count("Exchange hashpartitioning") == 1


def test_documents_are_broadcast_up_to_a_count(spark, monkeypatch):
    explanations = spark.createDataFrame([("e", "t")], "id string, retriever_type string")
    chunks = spark.createDataFrame([("l", "e", "d", 1)], "id string, explanation_id string, document_id string, rank int")
    documents = spark.createDataFrame([("d", "s")], "id string, source_name string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = joins.explanation_documents(explanations, chunks, documents)
        monkeypatch.setattr(joins, "BROADCAST_DOCUMENTS", 0)
        many = joins.explanation_documents(explanations, chunks, documents)
        assert "BroadcastHashJoin" in plan_of(few) and "BroadcastHashJoin" not in plan_of(many)
        assert few.collect() == many.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("table, parts", [(tables.MODELS, set()), (tables.PREDICTIONS, {"features"}), (tables.APPLICANTS, {"features"})])
def test_a_lookup_stores_its_own_table_only(fresh, table, parts):
    store = fresh.store(table)
    assert {r["table_name"] for r in store.manifest().collect()} == {table.name} and written() == parts


def test_stored_rows_equal_those_of_a_load(fresh):
    loaded = fresh.loaded_store()
    for table, stamp in ((tables.APPLICANTS, "created_at"), (tables.FEATURES, "computed_at")):
        own, other = (s.read(table.name).drop(stamp).orderBy("id").collect() for s in (fresh.store(table), loaded))
        assert own == other


def test_prediction_keys_move_fingerprints_only(fresh):
    shuffles = [line for line in fresh.applicant_keys()._jdf.queryExecution().executedPlan().toString().splitlines() if "WindowGroupLimit" in line]
    assert shuffles and "composite_risk_score" not in " ".join(shuffles)
    expected = fresh.applicants().select("row_no", F.col("id").alias("applicant_id"))
    assert sorted(fresh.applicant_keys().collect()) == sorted(expected.collect())


def test_duplicate_keys_by_hash(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 3)], "k string, n int")
    assert quality.has_duplicate_keys(rows, ["k"]) and not quality.has_duplicate_keys(rows, ["k", "n"])


def test_long_evaluators_of_the_rule_check_are_those_of_the_sample(fresh):
    counts = queries.dq_table_rules(fresh).where("table_name = 'evaluator_assessments' AND rule = 'evaluator_id: too long'").first()["row_count"]
    limit = tables.ASSESSMENTS.field("evaluator_id").max_length
    assert counts == fresh.long_evaluators().where(F.length("evaluator_id") > limit).count() > 0


def test_terms_of_a_chunk_stay_together(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a b b"), (2, "a c"), (3, None)], "id bigint, t string")
    few = retrieval.tfidf_weights(rows, "id", "t")
    assert "Exchange hashpartitioning" not in plan_of(few)
    monkeypatch.setattr(retrieval, "BROADCAST_VOCABULARY", 0)
    monkeypatch.setattr(retrieval, "TERM_PART", 1)
    assert sorted(few.collect()) == sorted(retrieval.tfidf_weights(rows, "id", "t").collect())


def test_only_sets_of_candidates_are_moved_to_be_compared(spark, monkeypatch):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [("a", words), ("b", words + " x"), ("c", words), ("d", "one two three four five six")]
    frame = spark.createDataFrame(rows, "id string, t string")
    found = []
    for limit in (similar_chunks.BROADCAST_IDS, 0):
        monkeypatch.setattr(similar_chunks, "BROADCAST_IDS", limit)
        links, _ = similar_chunks.near_duplicates(frame, "id", "t")
        found.append(sorted(links.collect()))
    assert found[0] == found[1] and [(r["a"], r["b"]) for r in found[0]] == [("a", "b")]
    monkeypatch.setattr(similar_chunks, "BROADCAST_IDS", 1_000_000)
    plan = similar_chunks.near_duplicates(frame, "id", "t")[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "rightHint=(strategy=broadcast)" in plan


def shuffle_files(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().toString()
    return files.count(".data")


def test_prompts_are_made_in_slices_whose_shuffle_files_are_deleted(fresh, spark, monkeypatch):
    lines = [(1, 1), (4, None), (7, None), (None, 2), (5, 3), (5, 3), (9, 4), (12, 5)]
    tables_of = {
        "lineitem": spark.createDataFrame(lines, "l_orderkey bigint, l_suppkey bigint"),
        "documents": spark.createDataFrame([(n, f"words of {n}", "s", 10) for n in range(9)], "doc_id bigint, text string, source string, n_chars bigint"),
    }
    monkeypatch.setattr(fresh, "table", tables_of.get)
    texts = fresh.documents().select(F.col("id").alias("document_id"), "chunk_text")
    whole = output_rules.prompts(fresh.explanation_chunks().join(texts, "document_id"), "explanation_id", "rank", "chunk_text", F.lit("Why was the loan decided so?"), 3)
    expected = {r["explanation_id"]: r["m"] for r in whole.select("explanation_id", F.md5(F.col("constructed_prompt").cast("binary")).alias("m")).collect()}
    monkeypatch.setattr(samples, "SLICE", 2)
    with fresh.pair_slices() as slices:
        assert len(slices) == 4 and sum(rows.count() for rows in slices) == 7
    before = shuffle_files(spark)
    found = queries.constructed_prompts(fresh).collect()
    assert len(found) == len(expected) == 5 and {r["explanation_id"]: r["prompt_md5"] for r in found} == expected
    until = time.monotonic() + 30
    while shuffle_files(spark) > before and time.monotonic() < until:
        time.sleep(0.2)
    assert shuffle_files(spark) <= before


def test_texts_of_prompts_are_not_gathered_before_the_shuffle(spark):
    chunks = spark.createDataFrame([("a", 1, "one"), ("b", 1, "x")], "q string, rank int, text string")
    plan = plan_of(output_rules.prompts(chunks, "q", "rank", "text", F.lit("Why?"), 2))
    assert plan.count("Exchange") == 1 and "partial_collect_list" not in plan.split("Exchange")[1]


def test_trees_of_all_folds_are_grown_together(spark, monkeypatch):
    names = ("a", "b")
    rows = spark.range(600).select(
        "id", (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 5).cast("int").alias("fold"),
        ((F.col("id") % 7) / 3.0 - 1).alias("a"), ((F.col("id") % 3) - 1.0).alias("b"),
    )
    scale = Scale(names, (0.0, 0.0), (1.0, 1.0))
    grown = []
    monkeypatch.setattr(trees, "grow", lambda *args, original=trees.grow, **named: grown.append(1) or original(*args, **named))
    together = training.out_of_fold(rows.withColumn("bins", F.array(*[trees.bin_of(F.col(n)) for n in names])), scale, "decision_tree")
    assert len(grown) == 1
    for number, nodes in enumerate(trees.fit_without_each_fold(rows, scale, 5)):
        alone = trees.fit_tree(rows.where(F.col("fold") != number), scale)
        assert [{**n.__dict__, "tree": 0} for n in nodes] == [n.__dict__ for n in alone]
    assert together.where("probability is null").isEmpty()


def test_features_read_cleaned_rows_that_are_derived_once(fresh, monkeypatch):
    passes = []
    monkeypatch.setattr(samples, "fit_and_engineer", lambda rows, original=samples.fit_and_engineer: passes.append(rows.inputFiles()) or original(rows))
    rows = fresh.features()
    assert len(passes) == 1 and all("cleaned-loans" in name for name in passes[0])
    assert rows.count() == fresh.loan_raw().count()


def test_numbers_as_given_are_kept_of_rejects_only(raw):
    rows = coercion.coerce_loans(build_feature_table(raw({}, {"person_age": "n/a", "person_income": "1e20"}), extra=("row_no",)))
    found = {r["row_no"]: r for r in coercion.given_of_rejects(rows).select("row_no", "storable", "given_person_income").collect()}
    assert found[0]["storable"] and found[0]["given_person_income"] is None
    assert not found[1]["storable"] and found[1]["given_person_income"] == 1e20
    whole, slim = (coercion.explain_rejects(r.where("not storable")).first()["violations"] for r in (rows, coercion.given_of_rejects(rows)))
    assert whole == slim and "person_income: out of range" in slim


@pytest.mark.parametrize("limit", [1_000_000, 2, 0])
def test_vectors_are_the_same_whichever_terms_are_broadcast(spark, monkeypatch, limit):
    monkeypatch.setattr(retrieval, "BROADCAST_VOCABULARY", limit)
    rows = [("a", "x y y"), ("a", "y z"), (None, "x q"), (None, "x"), ("b", "only here"), ("c", "x"), ("d", None), ("e", "12")]
    frame = spark.createDataFrame(rows, "id string, t string")
    counts = {"a": {"x": 1, "y": 3, "z": 1}, None: {"x": 2, "q": 1}, "b": {"only": 1, "here": 1}, "c": {"x": 1}}
    df = {t: sum(t in own for own in counts.values()) for own in counts.values() for t in own}
    found = {r["id"]: r["tfidf_vector"] for r in retrieval.tfidf_vectors(frame, "id", "t").collect()}
    assert found.keys() == counts.keys()
    for key, own in counts.items():
        weights = {t: n * (math.log(7 / (1 + df[t])) + 1) for t, n in own.items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        assert found[key] == pytest.approx({t: w / norm for t, w in weights.items()})


def test_weights_of_common_terms_are_not_shuffled(spark, monkeypatch):
    rows = spark.createDataFrame([(n, f"a b w{'x' * n}") for n in range(9)], "id bigint, t string")
    monkeypatch.setattr(retrieval, "BROADCAST_VOCABULARY", 3)
    own = retrieval.vocabulary(rows, "id", "t")
    assert sorted(r["term"] for r in own.common.collect()) == ["a", "b"] and own.rare.count() == 9
    plan = plan_of(retrieval.weighted_terms(own, "id"))
    # What is joined with the broadcast idf has been shuffled as lists, before their terms became rows.
    common = plan.split("SortMergeJoin")[1] if "SortMergeJoin" in plan else plan
    assert common.index("BroadcastHashJoin") < common.index("Generate") < common.index("Exchange hashpartitioning")


def test_the_length_of_a_chunk_is_summed_once(spark):
    rows = spark.createDataFrame([("a", "x y y")], "id string, t string")
    plan = retrieval.tfidf_vectors(rows, "id", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_repeat(SQRT(aggregate" in plan and plan.count("SQRT(aggregate") == 1


def test_links_are_joined_in_slices_whose_shuffle_files_are_deleted(fresh, spark, monkeypatch):
    lines = [(1, 1), (4, None), (7, None), (None, 2), (5, 3), (5, 3), (9, 4), (12, 5)]
    tables_of = {
        "lineitem": spark.createDataFrame(lines, "l_orderkey bigint, l_suppkey bigint"),
        "documents": spark.createDataFrame([(n, f"words of {n}", "s", 10) for n in range(9)], "doc_id bigint, text string, source string, n_chars bigint"),
    }
    monkeypatch.setattr(fresh, "table", tables_of.get)
    monkeypatch.setattr(joins, "BROADCAST_DOCUMENTS", 0)
    whole = queries.join_explanation_documents(fresh)
    expected = sorted(whole.collect())
    monkeypatch.setattr(samples, "LINK_SLICE", 2)
    before = shuffle_files(spark)
    found = queries.join_explanation_documents(fresh)
    assert found.columns == whole.columns and sorted(found.collect()) == expected and len(expected) > 5
    until = time.monotonic() + 30
    while shuffle_files(spark) > before and time.monotonic() < until:
        time.sleep(0.2)
    assert shuffle_files(spark) <= before
