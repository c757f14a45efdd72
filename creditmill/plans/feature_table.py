"""Raw loan applications to the feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from creditmill.config import FeatureConfig
from creditmill.operators.cleaning import clean_loans
from creditmill.operators.features import fit_and_engineer, select_features
from creditmill.session import staged
from creditmill.sources.files import load_raw, read_features, write_features


def build_feature_table(
    raw: DataFrame, config: FeatureConfig = FeatureConfig(), extra: tuple[str, ...] = ()
) -> DataFrame:
    """Clean, fit the dataset-wide statistics, derive and project all features.

    Two narrow passes fit the statistics (two and seven columns of a columnar
    source); the returned frame is a single projection over the input.
    """
    return select_features(fit_and_engineer(clean_loans(raw, config), config), extra)


def run_features(
    spark: SparkSession,
    input_path,
    output_path,
    config: FeatureConfig = FeatureConfig(),
    fmt: str = "parquet",
) -> DataFrame:
    """CSV in, feature table out; returns the table as written.

    The text file is parsed once: the cleaned rows go to parquet in the shared
    folder, and all three passes read their columns from there.
    """
    cleaned = clean_loans(load_raw(spark, input_path), config)
    with staged(cleaned, "cleaned-loans") as cleaned:
        table = select_features(fit_and_engineer(cleaned, config))
        write_features(table, output_path, fmt)
    return read_features(spark, output_path, fmt)
