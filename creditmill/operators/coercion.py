"""Turn feature rows into typed table rows and say which rows cannot be stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditmill.config import EDUCATION_SYNONYMS, INTENT_SYNONYMS, LoadConfig
from creditmill.functions.numeric import as_double, to_bool, to_decimal, to_int
from creditmill.functions.text import only_in, recode, strip
from creditmill.operators.quality import row_violations
from creditmill.sources.tables import APPLICANTS, FEATURES, Field, Table

# Filled in by the load itself, not read from the feature rows.
_GIVEN = {"id", "applicant_id", "created_at", "computed_at", "source_split", "loan_grade"}
_INTEGERS = {"int", "smallint"}
_LOWER = {"person_gender", "income_bucket", "employment_stability"}
_UPPER = {"person_home_ownership", "loan_intent"}
_SYNONYMS = {"person_education": EDUCATION_SYNONYMS, "loan_intent": INTENT_SYNONYMS}


def _stored(table: Table) -> list[Field]:
    return [f for f in table.fields if f.name not in _GIVEN]


def _is_number(field: Field) -> bool:
    return field.type in _INTEGERS or field.type.startswith("decimal")


_NUMBERS = [f for t in (APPLICANTS, FEATURES) for f in _stored(t) if _is_number(f)]


def _parsed(df: DataFrame) -> DataFrame:
    """Text numbers to double, before anything refers to them twice."""
    texts = [
        f.name
        for f in _NUMBERS
        if f.name in df.columns and isinstance(df.schema[f.name].dataType, T.StringType)
    ]
    return df.withColumns({name: as_double(df, name) for name in texts})


def _coerced(df: DataFrame, field: Field) -> Column:
    column = F.col(field.name)
    if field.domain is not None:
        text = strip(column.cast("string"))
        text = F.lower(text) if field.name in _LOWER else text
        text = F.upper(text) if field.name in _UPPER else text
        return only_in(recode(text, _SYNONYMS.get(field.name, {})), field.domain)
    if field.type == "boolean":
        return to_bool(df, field.name)
    if field.type in _INTEGERS:
        return to_int(column, field.type)
    if field.type.startswith("decimal"):
        return to_decimal(column, field.type)
    return column.cast("string")


def coerce_applicant(df: DataFrame, source_split: str = LoadConfig.source_split) -> DataFrame:
    """Applicant columns of the feature rows; other columns are kept as they are."""
    df = _parsed(df)
    return df.withColumns(
        {
            **{f.name: _coerced(df, f) for f in _stored(APPLICANTS)},
            "loan_grade": F.lit(None).cast("string"),
            "source_split": F.lit(source_split),
        }
    )


def coerce_features(df: DataFrame, default_version: str = LoadConfig.default_version) -> DataFrame:
    """Engineered columns of the feature rows; other columns are kept as they are."""
    if "pipeline_version" not in df.columns:
        df = df.withColumn("pipeline_version", F.lit(default_version))
    df = _parsed(df)
    columns = {f.name: _coerced(df, f) for f in _stored(FEATURES)}
    columns["pipeline_version"] = F.coalesce(columns["pipeline_version"], F.lit(default_version))
    return df.withColumns(columns)


def fingerprint_id(kind: str = APPLICANTS.name) -> Column:
    """Key of an application: a hash of its rounded fingerprint, equal on every run."""
    parts = [F.col(name).cast("string") for name in APPLICANTS.natural_key]
    return F.sha2(F.concat_ws("|", F.lit(kind), *parts), 256)


def _given(field: Field) -> str:
    return f"given_{field.name}"


def _does_not_fit(field: Field) -> str:
    """A number was given but its column cannot hold it.

    Infinity in a decimal column is only a missing value; in an integer column
    it makes the row unusable.
    """
    given = f"double(`{_given(field)}`)"
    present = f"isnotnull({given}) AND NOT isnan({given})"
    if field.type not in _INTEGERS:
        present += f" AND abs({given}) < double('Infinity')"
    return f"({present} AND isnull(`{field.name}`))"


def coerce_loans(df: DataFrame, config: LoadConfig = LoadConfig()) -> DataFrame:
    """Both coercions, the numbers as given, and ``storable``: no column refuses its value.

    A plain conjunction, so rows that can be stored cost no list of reasons;
    ``explain_rejects`` makes that list for those that cannot.
    """
    limit = APPLICANTS.field("source_split").max_length
    if len(config.source_split) > limit:
        raise ValueError(f"source_split is longer than {limit} characters")
    df = _parsed(df)
    df = df.withColumns({_given(f): F.col(f.name) for f in _NUMBERS})
    typed = df.transform(coerce_applicant, config.source_split).transform(
        coerce_features, config.default_version
    )
    fields = _stored(APPLICANTS) + _stored(FEATURES)
    holds = [f"isnotnull(`{f.name}`)" for f in fields if f.required]
    holds += [f"NOT {_does_not_fit(f)}" for f in _NUMBERS if not f.required]
    holds += [
        f"coalesce(length(`{f.name}`) <= {f.max_length}, true)" for f in fields if f.max_length
    ]
    return typed.withColumn("storable", F.expr(" AND ".join(holds)))


def given_of_rejects(coerced: DataFrame) -> DataFrame:
    """The numbers as given only where a row cannot be stored, as no other row is asked for them."""
    return coerced.withColumns({_given(f): F.when(~F.col("storable"), F.col(_given(f))) for f in _NUMBERS})


def explain_rejects(coerced: DataFrame) -> DataFrame:
    """Add ``violations``, the reasons why a coerced row cannot be stored."""
    misfits = [F.when(F.expr(_does_not_fit(f)), F.lit(f"{f.name}: out of range")) for f in _NUMBERS]
    rules = F.concat(
        F.filter(F.array(*misfits), lambda rule: rule.isNotNull()),
        row_violations(APPLICANTS, skip=_GIVEN),
        row_violations(FEATURES, skip=_GIVEN),
    )
    return coerced.withColumn("violations", rules).drop(*[_given(f) for f in _NUMBERS])


def stored_columns(coerced: DataFrame, *extra: str) -> DataFrame:
    """The columns of both tables that the rows bring along, plus ``extra``."""
    names = [f.name for f in (*APPLICANTS.fields, *FEATURES.fields)]
    return coerced.select(*extra, *[n for n in names if n in coerced.columns])
