"""Decisions taken on stored scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The decision policy.
HIGH_RISK_FROM = 0.8
MEDIUM_RISK_FROM = 0.5
ACTIONS = {
    "high": "immediate_retention_offer",
    "medium": "engagement_campaign",
    "low": "monitor_only",
}


def risk_tier(score: Column) -> Column:
    """high, medium or low; both limits belong to the upper tier."""
    return (
        F.when(score >= HIGH_RISK_FROM, "high").when(score >= MEDIUM_RISK_FROM, "medium")
        .when(score.isNotNull(), "low")
    )


def action(tier: Column) -> Column:
    choice = F
    for name, step in ACTIONS.items():
        choice = choice.when(tier == name, step)
    return choice


def top_attributions(shap_values: Column, k: int = 5) -> Column:
    """Names of the k entries of a map with the largest absolute value, in order; null values are passed over."""
    entries = F.transform(
        F.filter(F.map_entries(shap_values), lambda e: e["value"].isNotNull()),
        lambda e: F.struct((-F.abs(e["value"])).alias("weight"), e["key"].alias("name")),
    )
    return F.transform(F.slice(F.sort_array(entries), 1, k), lambda e: e["name"])
