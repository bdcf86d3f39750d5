"""Statistics that operators are fitted with.

Every fit is one distributed aggregate over all requested columns at once and
brings one row (or one row per wanted quantile) to the driver. Applying the
statistics as literals keeps the second pass free of joins and shuffles.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rinseframe.functions.columns import as_double, col, numeric_columns, require
from rinseframe.plans.lineage import cut_lineage, shuffle_partitions

AGGREGATES = {
    "count": F.count,
    "min": F.min,
    "max": F.max,
    "mean": F.avg,
    "std": F.stddev_samp,
}

# Rows that may lie between the bounds of all quantiles of a column before they are narrowed.
SPAN_ROWS = 2_000_000


def fit(df: DataFrame, names: list[str], stats: list[str]) -> dict[str, dict[str, float | None]]:
    """``{column: {stat: value}}`` for numeric columns, empty cells skipped."""
    if not names:
        return {}
    exprs = [
        AGGREGATES[stat](as_double(df, name)).alias(f"{i}_{stat}")
        for i, name in enumerate(names)
        for stat in stats
    ]
    row = df.agg(*exprs).first()
    return {name: {stat: row[f"{i}_{stat}"] for stat in stats} for i, name in enumerate(names)}


def column_stats(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row per numeric column: count, min, max, mean and sample deviation.

    One aggregate over all columns, whose single row is then laid out by column.
    """
    names = numeric_columns(df) if names is None else names
    require(df, *names)
    schema = "column string, count long, min double, max double, mean double, std double"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    whole = df.agg(*[agg(as_double(df, n)).alias(f"{i}_{stat}") for i, n in enumerate(names) for stat, agg in AGGREGATES.items()])
    rows = [F.struct(F.lit(n).alias("column"), *[F.col(f"{i}_{stat}").alias(stat) for stat in AGGREGATES]) for i, n in enumerate(names)]
    return whole.select(F.inline(F.array(*rows)))


def unpivot(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, x) rows for numeric columns; x is double, empty cells are NULL."""
    require(df, *names)
    cells = [F.struct(F.lit(n).alias("column"), as_double(df, n).alias("x")) for n in names]
    return df.select(F.inline(F.array(*cells)))


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """Occurrences of each non-empty value; partial counts are made before the shuffle."""
    require(df, name)
    return df.where(col(name).isNotNull()).groupBy(col(name).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def categories(df: DataFrame, name: str) -> DataFrame:
    """Sorted distinct non-empty values."""
    require(df, name)
    return df.where(col(name).isNotNull()).select(col(name).alias(name)).distinct().orderBy(col(name))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def quantiles(
    df: DataFrame, names: list[str], probabilities: list[float], margin: float | None = None
) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of several columns.

    A quantile sketch bounds each wanted value from both sides; the rows below and
    between the bounds are counted, and only values between them are counted one by
    one. Should the bounds still hold too many rows, the sketch is first run again
    between them. What one task ranks is bounded by ``SPAN_ROWS``, whatever the table: where
    bounds cannot be narrowed so far, the values are ranked over ranges.
    """
    if not names:
        return {}
    accuracy = max(1_000, 20 * len(probabilities))
    margin = margin or 2.0 / accuracy
    points = sorted({min(1.0, max(0.0, p + d)) for p in probabilities for d in (-margin, margin)})
    row = df.agg(
        *[F.count(as_double(df, n)).alias(f"{i}_n") for i, n in enumerate(names)],
        *[F.approx_percentile(as_double(df, n), points, accuracy).alias(f"{i}_q") for i, n in enumerate(names)],
    ).first()
    totals = {n: row[f"{i}_n"] for i, n in enumerate(names)}
    ranks, spans = {}, {}
    for i, name in enumerate(names):
        if totals[name] == 0:
            continue
        sketch = dict(zip(points, row[f"{i}_q"]))
        ranks[name] = {r for p in probabilities for r in _neighbour_ranks(totals[name], p)}
        spans[name] = _merge([(sketch[max(0.0, p - margin)], sketch[min(1.0, p + margin)]) for p in probabilities])
    rows = {n: totals[n] * 4 * margin * len(spans[n]) for n in spans}
    while wide := [n for n in spans if rows[n] > SPAN_ROWS]:
        narrowed, inside = _narrow(df, {n: spans[n] for n in wide}, ranks, accuracy)
        spans |= narrowed
        for n in wide:  # stop where a round no longer helps: one value has most of the rows
            expected = inside[n] * 4 * margin * len(spans[n])
            rows[n] = expected if expected < rows[n] / 2 else 0
    exact = _values_at(df, ranks, spans) if ranks else {}
    found: dict[str, list[float | None]] = {}
    for name in names:
        if totals[name] == 0:
            found[name] = [None] * len(probabilities)
        elif ranks[name] - exact[name].keys():  # a bound did not hold: take wider ones
            found[name] = quantiles(df, [name], probabilities, margin * 10)[name]
        else:
            found[name] = [_interpolate(exact[name], totals[name], p) for p in probabilities]
    return found


def _neighbour_ranks(n: int, p: float) -> set[int]:
    position = (n - 1) * p
    return {math.floor(position), math.ceil(position)}


def _interpolate(values: dict[int, float], n: int, p: float) -> float:
    position = (n - 1) * p
    low, high = values[math.floor(position)], values[math.ceil(position)]
    share = position - math.floor(position)
    return low + (high - low) * share if share < 0.5 else high - (high - low) * (1 - share)


def _merge(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    merged: list[tuple[float, float]] = []
    for low, high in sorted(spans):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def _inside(x: Column, spans: list[tuple[float, float]]) -> Column:
    return reduce(lambda a, b: a | b, [x.between(low, high) for low, high in spans])


def _span_counts(df: DataFrame, spans: dict[str, list[tuple[float, float]]]) -> dict[str, list[tuple[int, int]]]:
    """For every span the number of rows below it and inside it, in one aggregate."""
    counts = []
    for i, name in enumerate(spans):
        x = as_double(df, name)
        for j, (low, high) in enumerate(spans[name]):
            counts += [
                F.count_if(x < low).alias(f"{i}_{j}_below"),
                F.count_if(x.between(low, high)).alias(f"{i}_{j}_inside"),
            ]
    row = df.agg(*counts).first()
    return {
        name: [(row[f"{i}_{j}_below"], row[f"{i}_{j}_inside"]) for j in range(len(spans[name]))]
        for i, name in enumerate(spans)
    }


def _narrow(
    df: DataFrame, spans: dict[str, list[tuple[float, float]]], ranks: dict[str, set[int]], accuracy: int
) -> tuple[dict[str, list[tuple[float, float]]], dict[str, int]]:
    """Bracket the ranks again by a sketch of the rows inside each span, for all columns in two passes.

    Also returns the largest number of rows a given span of each column held.
    """
    requests, largest = {}, dict.fromkeys(spans, 0)
    for i, (name, counts) in enumerate(_span_counts(df, spans).items()):
        for j, (below, rows) in enumerate(counts):
            shares = [(r - below) / rows for r in ranks[name] if below <= r < below + rows]
            if shares and spans[name][j][0] < spans[name][j][1]:
                low, high = max(0.0, min(shares) - 2.0 / accuracy), min(1.0, max(shares) + 2.0 / accuracy)
                x = as_double(df, name)
                inside = F.when(_inside(x, [spans[name][j]]), x)
                requests[name, j] = F.approx_percentile(inside, [low, high], accuracy).alias(f"{i}_{j}")
                largest[name] = max(largest[name], rows)
    if not requests:
        return spans, largest
    sketch = df.agg(*requests.values()).first()
    positions = {name: i for i, name in enumerate(spans)}
    narrowed = {
        name: [tuple(sketch[f"{positions[name]}_{j}"]) if (name, j) in requests else span for j, span in enumerate(spans[name])]
        for name in spans
    }
    return narrowed, largest


def _placed(counted: DataFrame) -> DataFrame:
    """(column, x, first, past): the places that each of the counted values takes in its column."""
    past = F.sum("n").over(Window.partitionBy("column").orderBy("x"))
    return counted.select("column", "x", (past - F.col("n")).alias("first"), past.alias("past"))


def _placed_over_ranges(counted: DataFrame, places: set[tuple[str, int]]) -> DataFrame:
    """``_placed`` of the ranges of values that hold one of the places.

    Values are stored by ranges; the ranges' sums, a row for each, tell where each one's places
    begin, and only those with a wanted place are ranked.
    """
    ranges = counted.repartitionByRange(shuffle_partitions(counted.sparkSession), "column", "x")
    stored = cut_lineage(ranges.withColumn("range", F.spark_partition_id()))
    begins: dict[str, int] = {}
    held = []
    for row in stored.groupBy("column", "range").agg(F.sum("n").alias("n")).orderBy("range").collect():
        begin = begins.get(row["column"], 0)
        begins[row["column"]] = begin + row["n"]
        if any(name == row["column"] and begin <= place < begin + row["n"] for name, place in places):
            held.append((row["column"], row["range"], begin))
    chosen = stored.sparkSession.createDataFrame(held, "in_column string, in_range int, begin long")
    same = (F.col("column") == F.col("in_column")) & (F.col("range") == F.col("in_range"))
    past = F.col("begin") + F.sum("n").over(Window.partitionBy("column", "range").orderBy("x"))
    found = stored.join(F.broadcast(chosen), same)  # at most a range for each place
    return found.select("column", "x", (past - F.col("n")).alias("first"), past.alias("past"))


def _values_at(
    df: DataFrame, ranks: dict[str, set[int]], spans: dict[str, list[tuple[float, float]]]
) -> dict[str, dict[int, float]]:
    """Values at the wanted 0-based ranks, given spans that hold them.

    Only rows inside a span are counted by value; a rank among them is the wanted
    rank less the rows outside the spans before it.
    """
    wanted: dict[str, dict[int, int]] = {}
    most = 0
    for name, counts in _span_counts(df, spans).items():
        wanted[name], seen = {}, 0
        most = max(most, sum(rows for _, rows in counts))
        for below, rows in counts:
            wanted[name].update({r: r - below + seen for r in ranks[name] if below <= r < below + rows})
            seen += rows

    def cell(name: str) -> Column:
        x = as_double(df, name)
        return F.struct(F.lit(name).alias("column"), F.when(_inside(x, spans[name]), x).alias("x"))

    counted = (
        df.select(F.inline(F.array(*[cell(name) for name in spans])))
        .where(F.col("x").isNotNull())
        .groupBy("column", "x")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    places = {(name, place) for name, of_rank in wanted.items() for place in of_rank.values()}
    placed = _placed(counted) if most <= SPAN_ROWS else _placed_over_ranges(counted, places)
    hits = [
        (F.col("column") == name) & (F.col("first") <= place) & (F.col("past") > place)
        for name, place in sorted(places)
    ]
    values: dict[str, dict[int, float]] = {name: {} for name in ranks}
    for row in placed.where(reduce(lambda a, b: a | b, hits)).collect() if hits else []:
        for r, place in wanted[row["column"]].items():
            if row["first"] <= place < row["past"]:
                values[row["column"]][r] = row["x"]
    return values


def quantile_table(df: DataFrame, names: list[str], probabilities: list[float]) -> DataFrame:
    """The quantiles as rows (column, p, value)."""
    found = quantiles(df, names, probabilities)
    rows = [(n, float(p), v) for n in names for p, v in zip(probabilities, found[n])]
    return df.sparkSession.createDataFrame(rows, "column string, p double, value double")


__all__ = [
    "categories",
    "column_stats",
    "fit",
    "quantile_table",
    "quantiles",
    "row_count",
    "unpivot",
    "value_counts",
]
