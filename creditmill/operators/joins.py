"""Navigation between the stored tables, as set-based joins.

Adaptive execution broadcasts a side when its measured size allows it and splits the
partitions of a parent that most rows point to; the only hint is for documents that were counted.
Columns two tables share get the table's prefix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditmill.session import broadcast_up_to

#: Document chunks that are broadcast, counted first; beyond it the join is left to the optimizer.
BROADCAST_DOCUMENTS = 1_000_000


def _keyed(parent: DataFrame, key: str, prefix: str, other: DataFrame) -> DataFrame:
    """Rename the parent's id to the child's foreign key, and clashing columns."""
    taken = set(other.columns)
    names = {
        name: key if name == "id" else f"{prefix}_{name}" if name in taken else name
        for name in parent.columns
    }
    return parent.select(*[F.col(old).alias(new) for old, new in names.items()])


def applicant_with_features(applicants: DataFrame, features: DataFrame) -> DataFrame:
    """Every applicant, with its features where there are any."""
    child = features.drop("id")
    return _keyed(applicants, "applicant_id", "applicant", child).join(
        child, "applicant_id", "left"
    )


def applicant_predictions(applicants: DataFrame, predictions: DataFrame) -> DataFrame:
    child = predictions.withColumnRenamed("id", "prediction_id")
    return child.join(_keyed(applicants, "applicant_id", "applicant", child), "applicant_id")


def model_predictions(models: DataFrame, predictions: DataFrame) -> DataFrame:
    child = predictions.withColumnRenamed("id", "prediction_id")
    return child.join(_keyed(models, "model_id", "model", child), "model_id")


def prediction_explanations(predictions: DataFrame, explanations: DataFrame) -> DataFrame:
    """Every prediction, with its explanation where there is one."""
    child = explanations.withColumnRenamed("id", "explanation_id")
    return _keyed(predictions, "prediction_id", "prediction", child).join(
        child, "prediction_id", "left"
    )


def explanation_documents(
    explanations: DataFrame, chunks: DataFrame, documents: DataFrame
) -> DataFrame:
    """The document chunks each explanation used, through the junction table.

    Links outnumber both other tables by far. They are shuffled once, by explanation, as long as the columns of the
    documents can be broadcast.
    """
    links = chunks.drop("id")
    parents = broadcast_up_to(_keyed(documents, "document_id", "document", links), BROADCAST_DOCUMENTS)
    return links.join(parents, "document_id").join(
        _keyed(explanations, "explanation_id", "explanation", links), "explanation_id"
    )


def explanation_assessments(explanations: DataFrame, assessments: DataFrame) -> DataFrame:
    child = assessments.withColumnRenamed("id", "assessment_id")
    return child.join(
        _keyed(explanations, "explanation_id", "explanation", child), "explanation_id"
    )
