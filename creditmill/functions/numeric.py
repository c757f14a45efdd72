"""Number parsing, guarded arithmetic and typed coercion.

Two rules keep the results the same as a NaN-based data frame would give:
a NaN becomes null as soon as a value is read, and every yes/no column is made
with ``flag`` so that a comparison with a missing value is false, not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditmill.functions.text import WHITESPACE, strip

# The cast alone would also read "1d", "2f", "nan" and hexadecimal floats. A plain
# number ends in a digit or a point and has no "x", which is far cheaper to test
# than a regular expression; infinity may be spelled out.
_NUMBER = """
try_cast(CASE
  WHEN (substring({text}, -1, 1) BETWEEN '0' AND '9' OR endswith({text}, '.'))
       AND NOT contains({text}, 'x') AND NOT contains({text}, 'X')
    OR lower({text}) IN ('inf', '+inf', '-inf', 'infinity', '+infinity', '-infinity')
  THEN {text} END AS double)
"""


def parse_number(name: str) -> Column:
    """A text column as double; anything that is not a plain number becomes null."""
    return F.expr(_NUMBER.format(text=f"btrim(`{name}`, '{WHITESPACE}')"))


def as_double(df: DataFrame, name: str) -> Column:
    """A column as double without NaN, whatever the source stored it as."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return parse_number(name)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.expr(f"CASE WHEN NOT isnan(`{name}`) THEN double(`{name}`) END")
    return F.col(name).cast("double")


def flag(predicate: Column) -> Column:
    return F.coalesce(predicate, F.lit(False))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient where the denominator is above zero, null elsewhere."""
    return F.when(denominator > 0, numerator / denominator)


def floor_at_zero(value: Column) -> Column:
    """Clip below at zero; unlike greatest(), a null stays null."""
    return F.when(value < 0, F.lit(0.0)).otherwise(value)


def to_decimal(value: Column, kind: str) -> Column:
    """Double to a decimal type, half up; NaN and what does not fit give null.

    The detour over ten decimals makes the rounding follow the printed value
    (2208.075 gives 2208.08) instead of its binary neighbour.
    """
    return value.try_cast("decimal(38,10)").try_cast(kind)


def to_int(value: Column, kind: str = "int") -> Column:
    """Double to an integer type, towards zero; NaN and what does not fit give null."""
    return value.try_cast(kind)


def to_bool(df: DataFrame, name: str) -> Column:
    """Yes/no column from a boolean, a text or a number."""
    kind = df.schema[name].dataType
    column = F.col(name)
    if isinstance(kind, T.BooleanType):
        return column
    if isinstance(kind, T.StringType):
        return F.lower(strip(column)).isin("true", "1", "yes")
    return to_int(as_double(df, name), "bigint") != 0
