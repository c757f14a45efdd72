"""Normalise raw loan applications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditmill.config import MISSING_TOKENS, NUMERIC_COLUMNS, FeatureConfig
from creditmill.functions.numeric import as_double, flag
from creditmill.functions.text import recode, strip


def blank_missing_tokens(df: DataFrame, tokens=MISSING_TOKENS) -> DataFrame:
    """Turn the usual spellings of "no value" into null in every text column."""
    text_columns = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns(
        {name: F.when(~F.col(name).isin(*tokens), F.col(name)) for name in text_columns}
    )


def clean_loans(df: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Trim and recode the text columns, parse the numbers, cap the age.

    The default flag is false only for an exact "No"; a missing or unexpected
    answer counts as a default. ``loan_status`` is passed through as it came.
    """
    numbers = {name: as_double(df, name) for name in NUMERIC_COLUMNS}
    age = numbers["person_age"]
    defaults = F.col("previous_loan_defaults_on_file")
    if isinstance(df.schema["previous_loan_defaults_on_file"].dataType, T.BooleanType):
        has_default = F.coalesce(defaults, F.lit(True))
    else:
        has_default = F.coalesce(strip(defaults) != "No", F.lit(True))
    return df.withColumns(
        {
            **numbers,
            "person_age": F.when(age > config.age_cap, F.lit(config.age_cap)).otherwise(age),
            "previous_loan_defaults_on_file": has_default,
            "person_education": recode(
                strip(F.col("person_education")), config.education_synonyms
            ),
            "loan_intent": recode(strip(F.col("loan_intent")), config.intent_synonyms),
            "person_home_ownership": F.upper(strip(F.col("person_home_ownership"))),
            "person_gender": F.lower(strip(F.col("person_gender"))),
        }
    )


def count_age_outliers(df: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """How many raw ages are above the cap."""
    over = flag(as_double(df, "person_age") > config.age_cap)
    return df.agg(F.count_if(over).alias("age_outliers"))
