"""Text normalisation."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spark's trim() removes blanks only; raw files also carry tabs and line ends.
WHITESPACE = " \t\n\r\x0b\x0c"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def recode(text: Column, synonyms: Mapping[str, str]) -> Column:
    """Replace the listed spellings, keep every other value, nulls included."""
    result = text
    for spelling, canonical in synonyms.items():
        result = F.when(text == spelling, canonical).otherwise(result)
    return result


def only_in(text: Column, domain: Iterable[str]) -> Column:
    """The value itself when it belongs to the domain, null otherwise."""
    return F.when(text.isin(*domain), text)


def code_of(text: Column, codes: Mapping[str, int], default: int) -> Column:
    """Look a value up in a small code table; unknown and missing give the default."""
    by_code: dict[int, list[str]] = {}
    for value, code in codes.items():
        by_code.setdefault(code, []).append(value)
    branches = F
    for code, values in by_code.items():
        branches = branches.when(text.isin(*values), F.lit(code))
    return branches.otherwise(F.lit(default))
