"""Min-max normalisation and outlier removal."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinseframe.functions.columns import all_of, as_double, col, is_numeric, numeric_columns, replace_columns
from rinseframe.operators.stats import fit


def apply_normalize(df: DataFrame, params: dict[str, dict[str, float | None]]) -> DataFrame:
    """(x - min) / (max - min) with given bounds; a constant column becomes NULL."""
    exprs = {}
    for name, bounds in params.items():
        low, high = bounds["min"], bounds["max"]
        if low is None or high == low:
            exprs[name] = F.lit(None).cast("double")
        else:
            exprs[name] = (as_double(df, name) - F.lit(low)) / F.lit(high - low)
    return replace_columns(df, exprs)


def normalize(df: DataFrame, column: str) -> DataFrame:
    if not is_numeric(df, column):
        return df
    return apply_normalize(df, fit(df, [column], ["min", "max"]))


def normalize_all(df: DataFrame) -> DataFrame:
    return apply_normalize(df, fit(df, numeric_columns(df), ["min", "max"]))


def apply_remove_outliers(
    df: DataFrame, params: dict[str, dict[str, float | None]], outside_range: float
) -> DataFrame:
    """Keep rows within ``outside_range`` deviations of the mean in every given column.

    Empty cells and an undefined deviation (fewer than two values) drop the row.
    """
    kept = []
    for name, s in params.items():
        if s["std"] is None:
            kept.append(F.lit(False))
            continue
        reach = s["std"] * outside_range
        kept.append(F.abs(as_double(df, name) - F.lit(s["mean"]).cast("double")) <= F.lit(reach).cast("double"))
        if math.isfinite(reach) and math.isfinite(s["mean"]):
            # a little wider than the rule, on the column as it is, so that a scan can skip what is far outside
            wide = abs(reach) + 1e-9 * (abs(s["mean"]) + abs(reach))
            kept.append(col(name).between(s["mean"] - wide, s["mean"] + wide))
    return df.where(all_of(kept))


def remove_outliers(df: DataFrame, column: str, outside_range: float = 3.0) -> DataFrame:
    if not is_numeric(df, column):
        return df
    return apply_remove_outliers(df, fit(df, [column], ["mean", "std"]), outside_range)


def remove_all_outliers(df: DataFrame, outside_range: float = 3.0) -> DataFrame:
    """All statistics come from the whole table, so the order of columns is irrelevant."""
    return apply_remove_outliers(df, fit(df, numeric_columns(df), ["mean", "std"]), outside_range)
