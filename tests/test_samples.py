"""The sample tables keep the keys of the stored ones."""

import pytest

from creditmill.catalog import queries
from creditmill.catalog.samples import Samples
from creditmill.operators import quality


@pytest.fixture(scope="module")
def samples(spark, sf_dir):
    return Samples(spark, sf_dir)


def test_keys_are_unique(samples):
    for rows, keys in (
        (samples.predictions(), ["id"]),
        (samples.predictions(), ["applicant_id", "model_id"]),
        (samples.explanations(), ["prediction_id"]),
        (samples.explanation_chunks(), ["explanation_id", "rank"]),
        (samples.assessments(), ["explanation_id", "evaluator_id"]),
    ):
        assert quality.duplicate_keys(rows, keys).isEmpty()


def test_every_prediction_has_one_explanation(samples):
    joined = queries.join_prediction_explanations(samples)
    assert joined.count() == samples.predictions().count()


def test_later_chunks_are_retrieved(samples):
    assert queries.join_explanation_documents(samples).where("chunk_index > 0").count() > 0


def test_precision_is_a_share(samples):
    assert queries.precision_at_k(samples).where("not precision_at_k between 0 and 1").isEmpty()
