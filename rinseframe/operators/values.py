"""Find and replace, and filling of empty cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinseframe.functions.columns import (
    as_double,
    col,
    common_type,
    data_type,
    empty_as_null,
    is_numeric,
    is_string,
    literal_fits,
    numeric_columns,
    replace_columns,
    require,
)
from rinseframe.functions.regex import java_pattern, java_replacement
from rinseframe.functions.text import cell_text
from rinseframe.operators.stats import fit, quantiles


def _replacements(to_replace, value) -> dict:
    if isinstance(to_replace, dict):
        return to_replace
    if isinstance(to_replace, (list, tuple)):
        values = value if isinstance(value, (list, tuple)) else [value] * len(to_replace)
        if len(values) != len(to_replace):
            raise ValueError("as many replacements as values to replace are needed")
        return dict(zip(to_replace, values))
    return {to_replace: value}


def _replaced(df: DataFrame, name: str, mapping: dict) -> Column | None:
    """The column with whole cells replaced, None where no key has its type."""
    dtype = data_type(df, name)
    fitting = {k: v for k, v in mapping.items() if literal_fits(dtype, k)}
    if not fitting:
        return None
    target = common_type(dtype, fitting.values())
    as_text = target != dtype and target == T.StringType()
    result = F
    for old, new in fitting.items():
        result = result.when(col(name) == F.lit(old), F.lit(str(new) if as_text and new is not None else new).cast(target))
    return result.otherwise(cell_text(df, name) if as_text else col(name).cast(target))


def find_replace(df: DataFrame, column: str, to_replace, value=None) -> DataFrame:
    """Replace whole cells equal to ``to_replace``; text never equals a number.

    A fraction among whole numbers makes the column double, any other mix makes it text.

    ``to_replace`` may be one value, a list, or a dict of simultaneous replacements.
    """
    require(df, column)
    replaced = _replaced(df, column, _replacements(to_replace, value))
    return df if replaced is None else replace_columns(df, {column: replaced})


def find_replace_all(df: DataFrame, to_replace, value=None) -> DataFrame:
    """``find_replace`` over every column whose type fits, in one projection."""
    mapping = _replacements(to_replace, value)
    exprs = {name: _replaced(df, name, mapping) for name in df.columns}
    return replace_columns(df, {n: e for n, e in exprs.items() if e is not None})


def find_replace_regex(df: DataFrame, column: str, pattern: str, replacement: str) -> DataFrame:
    """Replace every match of a Python-style pattern inside the cells of a text column."""
    if not is_string(df, column):
        return df
    changed = F.regexp_replace(
        col(column), F.lit(java_pattern(pattern)), F.lit(java_replacement(replacement, pattern))
    )
    return replace_columns(df, {column: changed})


def apply_fill(df: DataFrame, fills: dict[str, float | None]) -> DataFrame:
    """Fill empty numeric cells with given numbers; the columns become double."""
    return replace_columns(
        df, {n: F.coalesce(as_double(df, n), F.lit(v).cast("double")) for n, v in fills.items()}
    )


def _fill_mean(df: DataFrame, names: list[str]) -> DataFrame:
    return apply_fill(df, {n: s["mean"] for n, s in fit(df, names, ["mean"]).items()})


def _fill_median(df: DataFrame, names: list[str]) -> DataFrame:
    return apply_fill(df, {n: v[0] for n, v in quantiles(df, names, [0.5]).items()})


def fill_mean(df: DataFrame, column: str) -> DataFrame:
    return _fill_mean(df, [column]) if is_numeric(df, column) else df


def fill_median(df: DataFrame, column: str) -> DataFrame:
    return _fill_median(df, [column]) if is_numeric(df, column) else df


def fill_all_mean(df: DataFrame) -> DataFrame:
    return _fill_mean(df, numeric_columns(df))


def fill_all_median(df: DataFrame) -> DataFrame:
    return _fill_median(df, numeric_columns(df))


def fill_value(df: DataFrame, column: str, value) -> DataFrame:
    """Fill empty cells with a value; a fraction makes whole numbers double, another type makes the column text."""
    dtype = data_type(df, column)
    target = common_type(dtype, [value])
    if target == T.StringType() and dtype != target:
        filled = F.coalesce(cell_text(df, column), F.lit(str(value)))
    else:
        filled = F.coalesce(empty_as_null(df, column).cast(target), F.lit(value).cast(target))
    return replace_columns(df, {column: filled})


def fill_empty(df: DataFrame, column: str, how: str, value=None) -> DataFrame:
    """Fill by ``mean``, ``median`` or ``value``; any other choice changes nothing."""
    if how == "mean":
        return fill_mean(df, column)
    if how == "median":
        return fill_median(df, column)
    if how == "value":
        return fill_value(df, column, value)
    return df
