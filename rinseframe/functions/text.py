"""Text form of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinseframe.functions.columns import col, data_type, empty_as_null


def number_text(x: Column) -> Column:
    """Shortest decimal text: plain digits for 1e-4 <= |x| < 1e16, else like 1e+16."""
    magnitude = F.abs(x)
    usual = ((magnitude >= 1e-3) & (magnitude < 1e7)) | (magnitude == 0)
    # as a lambda, the rare forms stay out of the generated code, which otherwise grows
    # with every column until the JVM no longer compiles it
    rare = F.transform(F.array(x), _rare_number_text)
    return F.when(usual, x.cast("string")).otherwise(rare[0])


def _rare_number_text(x: Column) -> Column:
    """For numbers the JVM writes like 1.0E16."""
    text, magnitude = x.cast("string"), F.abs(x)
    plain = F.regexp_replace(text.cast("decimal(38,22)").cast("string"), r"(\.[0-9]+?)0+$", "$1")
    # 1.0E16 to 1e+16, 1.5E-7 to 1.5e-07
    power = F.regexp_replace(F.regexp_replace(text, r"(?:\.0)?E-", "e-"), r"(?:\.0)?E", "e+")
    power = F.regexp_replace(power, r"(e[+-])([0-9])$", "$10$2")
    return (
        F.when((magnitude >= 1e-4) & (magnitude < 1e16), plain)
        .when(magnitude == float("inf"), F.replace(F.lower(text), F.lit("inity"), F.lit("")))
        .otherwise(power)
    )


def cell_text(df: DataFrame, name: str) -> Column:
    """The column as text; empty cells stay empty."""
    dtype = data_type(df, name)
    if isinstance(dtype, T.FloatType):
        # through its own shortest decimal, so 0.1 stays 0.1
        return number_text(empty_as_null(df, name).cast("string").cast("double"))
    if isinstance(dtype, T.DoubleType):
        return number_text(empty_as_null(df, name))
    if isinstance(dtype, T.BooleanType):
        return F.when(col(name), "True").when(~col(name), "False")
    return empty_as_null(df, name).cast("string")
