"""Column lookups, type gates and the empty-cell rule shared by all operators.

An operator applied to a column of the wrong type returns its input unchanged,
an unknown column name is an error. NULL and NaN both mean "empty".
"""

from __future__ import annotations

import datetime
import decimal
import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    """Column by its exact name, also when the name holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"unknown column(s) {missing}, table has {df.columns}")


def data_type(df: DataFrame, name: str) -> T.DataType:
    require(df, name)
    return df.schema[name].dataType


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), T.NumericType)


def is_string(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), T.StringType)


def is_datetime(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), (T.DateType, T.TimestampType, T.TimestampNTZType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def empty_as_null(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL."""
    if isinstance(data_type(df, name), (T.DoubleType, T.FloatType)):
        return F.nanvl(col(name), F.lit(None))
    return col(name)


def as_double(df: DataFrame, name: str) -> Column:
    return empty_as_null(df, name).cast("double")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Apply the empty-cell rule to every floating-point column."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return replace_columns(df, {n: empty_as_null(df, n) for n in floats})


def replace_columns(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """Give columns new values in one projection, keeping column order."""
    if not exprs:
        return df
    return df.select(*[exprs[n].alias(n) if n in exprs else col(n) for n in df.columns])


def all_of(conditions: Iterable[Column]) -> Column:
    result = F.lit(True)
    for condition in conditions:
        result = result & condition
    return result


def common_type(dtype: T.DataType, values: Iterable) -> T.DataType:
    """The type of a column that also takes these values: numbers among numbers become double, all else text."""
    others = [v for v in values if v is not None and not literal_fits(dtype, v)]
    if not others:
        return dtype
    numbers = all(isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool) for v in others)
    return T.DoubleType() if numbers and isinstance(dtype, T.NumericType) else T.StringType()


def literal_fits(dtype: T.DataType, value) -> bool:
    """Whether a Python value can equal, or be stored in, a column of this type."""
    if isinstance(value, bool):
        return isinstance(dtype, T.BooleanType)
    if isinstance(value, int):
        return isinstance(dtype, T.NumericType)
    if isinstance(value, (float, decimal.Decimal)):
        return isinstance(dtype, (T.FractionalType, T.DecimalType)) or (
            isinstance(dtype, T.IntegralType) and math.isfinite(value) and value == int(value)
        )
    if isinstance(value, str):
        return isinstance(dtype, T.StringType)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))
    return False
