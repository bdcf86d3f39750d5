"""Row deletion, column selection, ordering and paging."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinseframe.functions.columns import col, data_type, is_datetime, is_numeric, is_string, require
from rinseframe.plans.lineage import cut_lineage

# Pages ending beyond this row are located by counting partitions instead of by top-k.
TOP_K_ROWS = 100_000
# Rows an envelope, which goes through the driver, may hold.
ENVELOPE_ROWS = 10_000


class Cell(str):
    """Marks an operand of a comparison as a column name."""


def _operand(df: DataFrame, operand) -> tuple[Column, str]:
    if not isinstance(operand, Cell):
        kind = "text" if isinstance(operand, str) else "number"
        return F.lit(operand), kind
    if is_string(df, operand):
        return col(operand), "text"
    if is_numeric(df, operand):
        return col(operand), "number"
    return col(operand), "date" if is_datetime(df, operand) else data_type(df, operand).simpleString()


def comparison(df: DataFrame, left, op: str, right) -> Column:
    """``left op right`` with op one of ``= < > CONTAINS``; wrap column names in ``Cell``."""
    (a, a_kind), (b, b_kind) = _operand(df, left), _operand(df, right)
    if {a_kind, b_kind} == {"date", "text"}:
        a, b = (a.cast("timestamp_ntz"), b.cast("timestamp_ntz"))
    elif a_kind != b_kind:
        raise TypeError(f"cannot compare {a_kind} with {b_kind}")
    if op == "CONTAINS":
        if a_kind != "text":
            raise TypeError("CONTAINS needs text on both sides")
        return a.contains(b)
    if op == "=":
        return a == b
    if op == "<":
        return a < b
    if op == ">":
        return a > b
    raise ValueError(f"unknown comparison {op!r}")


def delete_rows(df: DataFrame, *comparisons: tuple, connective: str = "AND", negate_last: bool = False) -> DataFrame:
    """Delete rows matching one comparison, or two joined by AND / OR.

    A comparison is ``(left, op, right)``. As in SQL, a row for which the
    predicate is unknown (because of NULL) stays.
    """
    if len(comparisons) not in (1, 2):
        raise ValueError("one or two comparisons are needed")
    if connective not in ("AND", "OR"):
        raise ValueError(f"unknown connective {connective!r}")
    predicate = comparison(df, *comparisons[0])
    if len(comparisons) == 2:
        second = comparison(df, *comparisons[1])
        second = ~second if negate_last else second
        predicate = (predicate & second) if connective == "AND" else (predicate | second)
    kept = [_kept(df, *c) for c in comparisons]
    if kept[0] is not None and (len(kept) == 1 or (connective == "OR" and not negate_last and kept[1] is not None)):
        return df.where(kept[0] if len(kept) == 1 else kept[0] & kept[1])
    return df.where(~F.coalesce(predicate, F.lit(False)))


def _kept(df: DataFrame, left, op: str, right) -> Column | None:
    """What one comparison of a column with a literal leaves, in a form that reaches the file scan.

    None for comparisons without such a form. Floating-point columns are among them: they
    may hold NaN, which the statistics of a file need not cover.
    """
    if not isinstance(left, Cell) and isinstance(right, Cell):
        left, op, right = right, {"<": ">", ">": "<"}.get(op, op), left
    if not isinstance(left, Cell) or isinstance(right, Cell) or op not in ("=", "<", ">"):
        return None
    if not (is_string(df, left) or isinstance(data_type(df, left), T.IntegralType)):
        return None
    value = F.lit(right)
    opposite = {"=": col(left) != value, "<": col(left) >= value, ">": col(left) <= value}[op]
    return opposite | col(left).isNull()


def delete_where(df: DataFrame, predicate: str) -> DataFrame:
    """``delete_rows`` for text like ``price > 10 AND NOT name CONTAINS 'x'``."""
    if "--" in predicate:
        raise ValueError("'--' is not allowed in a predicate")
    names = "|".join(re.escape(n) for n in sorted(df.columns, key=len, reverse=True))
    operand = rf"(?:{names})|\d+(?:\.\d+)?|'(?:\\.|[^\\'])*'|\"(?:\\.|[^\\\"])*\""
    one = rf"({operand})\s*(=|<|>|CONTAINS)\s*({operand})"
    match = re.fullmatch(rf"\s*{one}(?:\s*\b(AND|OR)\b\s*(NOT\b)?\s*{one})?\s*", predicate)
    if match is None:
        raise ValueError(f"predicate not understood: {predicate!r}")

    def value(text: str):
        if text[0] in "'\"":
            return re.sub(r"\\(.)", r"\1", text[1:-1])
        if text in df.columns:
            return Cell(text)
        return float(text) if "." in text else int(text)

    left, op, right, connective, negated, left2, op2, right2 = match.groups()
    comparisons = [(value(left), op, value(right))]
    if connective:
        comparisons.append((value(left2), op2, value(right2)))
    return delete_rows(df, *comparisons, connective=connective or "AND", negate_last=bool(negated))


def select_column(df: DataFrame, column: str) -> DataFrame:
    require(df, column)
    return df.select(col(column).alias(column))


def drop_column(df: DataFrame, column: str) -> DataFrame:
    require(df, column)
    return df.select(*[col(n) for n in df.columns if n != column])


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Show columns under their labels."""
    require(df, *names)
    return df.select(*[col(n).alias(names.get(n, n)) for n in df.columns])


def describe_columns(df: DataFrame) -> DataFrame:
    """(name, type, position) of each column."""
    rows = [(f.name, f.dataType.simpleString(), i) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "name string, type string, position int")


def sort_keys(df: DataFrame, order: list[dict]) -> list[Column]:
    """Sort columns from ``{"column": index, "dir": text}`` entries.

    "asc" in any case sorts upwards, other text downwards; malformed entries are
    skipped. NULL counts as the largest value.
    """
    keys = []
    for entry in order:
        index, direction = entry.get("column"), entry.get("dir")
        if type(index) is not int or not isinstance(direction, str):
            continue
        if not 0 <= index < len(df.columns):
            raise IndexError(f"no column at position {index}")
        c = col(df.columns[index])
        keys.append(c.asc_nulls_last() if direction.lower() == "asc" else c.desc_nulls_first())
    return keys


def order_multi(df: DataFrame, order: list[dict]) -> DataFrame:
    keys = sort_keys(df, order)
    return df.orderBy(*keys) if keys else df


def page(df: DataFrame, start: int = 0, length: int = 10, order: list[dict] = ()) -> DataFrame:
    """Rows ``start`` to ``start + length`` in the given order.

    All sortable columns follow as tie-breakers, so pages never overlap. A page far
    from the top is found from the row counts of a range-sorted, checkpointed copy;
    only its own rows are then ranked.
    """
    start = start if type(start) is int else 0
    length = length if type(length) is int else 10
    sortable = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    keys = sort_keys(df, list(order)) + [col(n).asc_nulls_last() for n in sortable]
    if start + length <= TOP_K_ROWS:
        return df.orderBy(*keys).offset(start).limit(length)
    ranged = cut_lineage(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    counts = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())
    offsets, seen = {}, 0
    for part, rows in counts:
        if seen < start + length and seen + rows > start:
            offsets[part] = seen
        seen += rows
    if not offsets:
        return ranged.drop("_part").limit(0)
    offset = F.lit(0)
    for part, before in offsets.items():
        offset = F.when(F.col("_part") == part, F.lit(before)).otherwise(offset)
    position = offset + F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return (
        ranged.where(F.col("_part").isin(list(offsets)))
        .withColumn("_position", position)
        .where((F.col("_position") > start) & (F.col("_position") <= start + length))
        .orderBy("_position")
        .drop("_part", "_position")
    )


def _page_request(df: DataFrame, request: dict) -> DataFrame:
    order = request.get("order")
    return page(df, request.get("start", 0), request.get("length", 10), order if isinstance(order, list) else [])


def page_envelope(df: DataFrame, request: dict) -> dict | None:
    """The answer to a paging request: draw, total row count and the rows of the page.

    It is made on the driver, so pages of more than ``ENVELOPE_ROWS`` rows are an error.
    """
    if "draw" not in request:
        return None
    length = request.get("length", 10)
    if type(length) is int and length > ENVELOPE_ROWS:
        raise ValueError(f"a page of {length} rows is too long, at most {ENVELOPE_ROWS} are given out at once")
    rows = _page_request(df, request)
    total = df.count()
    return {
        "draw": int(request["draw"]),
        "recordsTotal": total,
        "recordsFiltered": total,
        "data": [list(r) for r in rows.collect()],
    }


def page_table(df: DataFrame, request: dict) -> DataFrame:
    """The same answer as a table: the page's rows, each with draw and totals."""
    total = df.count()
    return _page_request(df, request).select(
        F.lit(int(request["draw"])).alias("draw"),
        F.lit(total).cast("long").alias("records_total"),
        F.lit(total).cast("long").alias("records_filtered"),
        *[col(n) for n in df.columns],
    )
