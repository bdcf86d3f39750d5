"""Type changes and date parts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinseframe.functions.columns import (
    as_double,
    col,
    data_type,
    is_datetime,
    is_numeric,
    is_string,
    replace_columns,
)
from rinseframe.functions.text import cell_text

# Text layouts tried in this order when no format is given.
DATETIME_FORMATS = [
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd",
    "yyyyMMdd",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy H:mm",
    "M/d/yyyy",
    "d-MMM-yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
]


def _to_double(df: DataFrame, name: str, errors: str) -> Column:
    dtype = data_type(df, name)
    if isinstance(dtype, T.StringType):
        cell = col(name)
        parsed = F.nanvl(cell.try_cast("double"), F.lit(None))
        if errors == "null":
            return parsed
        return F.nanvl(cell.cast("double"), F.lit(None))
    if isinstance(dtype, T.BooleanType):
        return col(name).cast("int").cast("double")
    if isinstance(dtype, T.NumericType):
        return as_double(df, name)
    raise TypeError(f"column {name!r} of type {dtype.simpleString()} has no numeric value")


def _shape(layout: str) -> str:
    """Regular expression of the texts a layout can read."""
    parts = re.findall(r"y+|M+|d+|H+|m+|s+|S+|.", layout)
    return "^" + "".join(_letters(part) for part in parts) + "$"


def _letters(part: str) -> str:
    if part[0] not in "yMdHmsS":
        return re.escape(part)
    if part in ("MMM", "MMMM"):
        return r"\p{L}+\.?"
    if part[0] == "S":
        return f"[0-9]{{1,{len(part)}}}"
    return "[0-9]{1,2}" if len(part) == 1 else f"[0-9]{{{len(part)}}}"


def _to_datetime(df: DataFrame, name: str, formats: list[str], errors: str) -> Column:
    if is_datetime(df, name):
        return col(name).cast("timestamp_ntz")
    if is_numeric(df, name):  # nanoseconds since the epoch, kept to the microsecond
        micros = F.floor(as_double(df, name) / 1000).cast("bigint")
        if isinstance(data_type(df, name), T.IntegralType):
            whole = col(name).cast("bigint")
            micros = F.call_function("div", whole, F.lit(1000))
        epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
        return epoch + F.make_dt_interval(secs=(micros / F.lit(1_000_000).cast("decimal(18,6)")).cast("decimal(18,6)"))
    if not is_string(df, name):
        raise TypeError(f"column {name!r} cannot become a date and time")
    cell = col(name)
    # a text is only parsed by layouts it has the shape of
    attempts = [
        F.when(cell.rlike(_shape(f)), F.try_to_timestamp(cell, F.lit(f)).cast("timestamp_ntz")) for f in formats
    ]
    parsed = F.coalesce(cell.try_cast("timestamp_ntz"), *attempts)
    if errors == "null":
        return parsed
    unread = F.raise_error(F.concat(F.lit("cannot read as date and time: "), cell)).cast("timestamp_ntz")
    return F.when(cell.isNull(), F.lit(None)).otherwise(F.coalesce(parsed, unread))


def change_type(
    df: DataFrame, column: str, new_type: str, formats: list[str] | None = None, errors: str = "raise"
) -> DataFrame:
    """Change a column to ``string``, ``int``, ``float`` or ``datetime``.

    Any other name changes nothing. Empty cells stay empty. ``int`` goes through
    double and rounds halves to the even neighbour. Unreadable text raises, or
    becomes NULL with ``errors="null"``.
    """
    data_type(df, column)
    if new_type == "string":
        changed = cell_text(df, column)
    elif new_type == "float":
        changed = _to_double(df, column, errors)
    elif new_type == "int":
        changed = F.rint(_to_double(df, column, errors)).cast("bigint")
    elif new_type == "datetime":
        changed = _to_datetime(df, column, formats or DATETIME_FORMATS, errors)
    else:
        return df
    return replace_columns(df, {column: changed})


# Names of the parts that can be taken from a date.
DATE_PARTS = {
    "year": F.year,
    "month": F.month,
    "week": F.weekofyear,
    "day": F.dayofmonth,
    "weekday": lambda c: F.date_format(c, "EEEE"),
}


def extract_from_datetime(df: DataFrame, column: str, part: str) -> DataFrame:
    """Replace a date by its year, month, ISO week, day or English weekday name."""
    if not is_datetime(df, column) or part not in DATE_PARTS:
        return df
    return replace_columns(df, {column: DATE_PARTS[part](col(column))})

