"""Discretisation into labelled (lo, hi] intervals, and the column profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rinseframe.functions.bins import equal_width_edges, interval_labels, interval_lookup
from rinseframe.functions.columns import as_double, col, is_numeric, numeric_columns
from rinseframe.operators.stats import fit, quantiles

PROFILE_BINS = 15


def apply_bins(
    df: DataFrame, column: str, edges: list[float], include_lowest: bool = False, id_column: str | None = None
) -> DataFrame:
    """Replace a number by the label of its interval, optionally adding the 1-based bin."""
    value = as_double(df, column)
    if include_lowest:  # the lowest value belongs to the first interval
        value = F.when(value == F.lit(edges[0]), F.lit(edges[1])).otherwise(value)
    labelled = interval_lookup(value, edges, interval_labels(edges, include_lowest))
    selected = [labelled.alias(n) if n == column else col(n) for n in df.columns]
    if id_column is not None:
        selected.append(interval_lookup(value, edges, list(range(1, len(edges)))).alias(id_column))
    return df.select(*selected)


def bin_equiwidth(df: DataFrame, column: str, bins: int, id_column: str | None = None) -> DataFrame:
    if not is_numeric(df, column):
        return df
    bounds = fit(df, [column], ["min", "max"])[column]
    if bounds["min"] is None:
        raise ValueError(f"column {column!r} holds no value to bin")
    return apply_bins(df, column, equal_width_edges(bounds["min"], bounds["max"], bins), id_column=id_column)


def bin_equifreq(df: DataFrame, column: str, bins: int, id_column: str | None = None) -> DataFrame:
    """Edges are exact quantiles; equal edges are an error."""
    if not is_numeric(df, column):
        return df
    edges = quantiles(df, [column], [i / bins for i in range(bins + 1)])[column]
    if edges[0] is None:
        raise ValueError(f"column {column!r} holds no value to bin")
    return apply_bins(df, column, edges, include_lowest=True, id_column=id_column)


def bin_ranges(df: DataFrame, column: str, boundaries: list[float], id_column: str | None = None) -> DataFrame:
    """Bins between given inner boundaries; ones outside [min, max] change nothing."""
    if not is_numeric(df, column):
        return df
    if not boundaries:
        raise IndexError("at least one boundary is needed")
    inner = sorted(float(b) for b in boundaries)
    bounds = fit(df, [column], ["min", "max"])[column]
    low, high = bounds["min"], bounds["max"]
    if low is None or inner[0] < low or inner[-1] > high:
        return df if id_column is None else df.withColumn(id_column, F.lit(None).cast("int"))
    edges = [low - (high - low) / 1000, *inner, high]
    return apply_bins(df, column, edges, id_column=id_column)


def profile_histogram(df: DataFrame, bins: int = PROFILE_BINS) -> DataFrame:
    """(column, position, n): equal-width bin counts of every column, largest first.

    A column that is not numeric gets ``bins`` ones. Two passes over the table for
    all columns together.
    """
    numeric = numeric_columns(df)
    bounds = {n: b for n, b in fit(df, numeric, ["min", "max"]).items() if b["min"] is not None}
    spark = df.sparkSession
    bin_ids = list(range(1, bins + 1))
    others = [n for n in df.columns if n not in numeric]
    flat = spark.createDataFrame(
        [(n, i, 1) for n in others for i in bin_ids] + [(n, i, 0) for n in numeric if n not in bounds for i in bin_ids],
        "column string, position int, n long",
    )
    if not bounds:
        return flat
    cells = [
        F.struct(
            F.lit(n).alias("column"),
            interval_lookup(as_double(df, n), equal_width_edges(b["min"], b["max"], bins), bin_ids).alias("bin"),
        )
        for n, b in bounds.items()
    ]
    counted = (
        df.select(F.inline(F.array(*cells)))
        .where(F.col("bin").isNotNull())
        .groupBy("column", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    every = spark.createDataFrame([(n, i) for n in bounds for i in bin_ids], "column string, bin int")
    largest_first = Window.partitionBy("column").orderBy(F.desc("n"), "bin")
    return (
        every.join(counted, ["column", "bin"], "left")
        .select("column", "bin", F.coalesce("n", F.lit(0)).alias("n"))
        .select("column", F.row_number().over(largest_first).alias("position"), "n")
        .unionByName(flat)
    )
