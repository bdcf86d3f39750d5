"""One-hot encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinseframe.functions.columns import col, is_string, require
from rinseframe.plans.lineage import cut_lineage, numbered_in_order


def fit_categories(df: DataFrame, column: str, max_categories: int | None = None) -> list[str]:
    """Sorted distinct values. A limit can be asked for; more categories are then an error, never cut off."""
    distinct = df.where(col(column).isNotNull()).select(col(column).alias("v")).distinct()
    found = [row["v"] for row in (distinct if max_categories is None else distinct.limit(max_categories + 1)).collect()]
    if max_categories is not None and len(found) > max_categories:
        raise ValueError(f"column {column!r} has more than {max_categories} categories")
    return sorted(found)


def apply_one_hot(df: DataFrame, column: str, categories: list[str], use_old_name: bool) -> DataFrame:
    """One 0/1 column per category in place of the source column; empty cells are all 0."""
    names = [f"{column}_{c}" if use_old_name else c for c in categories]
    others = [n for n in df.columns if n != column]
    lowered = [n.lower() for n in others + names]
    clash = sorted({n for n in others + names if lowered.count(n.lower()) > 1})
    if clash:
        raise ValueError(f"one-hot columns clash by name: {clash}")
    selected = []
    for name in df.columns:
        if name == column:
            flags = [(F.coalesce(col(column) == c, F.lit(False))).cast("int") for c in categories]
            selected += [flag.alias(n) for flag, n in zip(flags, names)]
        else:
            selected.append(col(name))
    return df.select(*selected)


def one_hot_encode(
    df: DataFrame,
    column: str,
    use_old_name: bool = True,
    max_categories: int | None = None,
    categories: list[str] | None = None,
) -> DataFrame:
    """Encode by the column's own categories, or by given ones without a pass over the rows.

    The result has a column for each category, whose names are gathered; where these are too
    many, ``one_hot_sparse`` and ``one_hot_long`` are the forms to use.
    """
    if not is_string(df, column):
        return df
    found = fit_categories(df, column, max_categories) if categories is None else categories
    return apply_one_hot(df, column, found, use_old_name)


def one_hot_long(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys, category) for every cell that holds a category: the ones of the encoding, one to a row."""
    require(df, column, *keys)
    return df.where(col(column).isNotNull()).select(*[col(k).alias(k) for k in keys], col(column).alias("category"))


def one_hot_dictionary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(position, category, index): the categories of each column, numbered from 0 by column, then by text, as a stored table."""
    require(df, *columns)
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), col(c).cast("string").alias("category")) for i, c in enumerate(columns)]))
    found = df.select(cells.alias("cell")).where("cell.category IS NOT NULL").select("cell.position", "cell.category").distinct()
    return cut_lineage(numbered_in_order(found, ["position", "category"], "index"))


def one_hot_sparse(df: DataFrame, columns: list[str], dictionary: DataFrame | None = None, name: str = "one_hot") -> DataFrame:
    """The columns as one sparse vector (size, indices, values) under ``name``; categories are never gathered.

    Empty cells, and categories that a given dictionary does not have, have no entry. The
    dictionary is joined as a table of any size; Spark broadcasts it where it is small.
    """
    require(df, *columns)
    dictionary = one_hot_dictionary(df, columns) if dictionary is None else dictionary
    size = dictionary.agg((F.coalesce(F.max("index"), F.lit(-1)) + 1).cast("int").alias("n")).first()["n"]
    others = [c for c in df.columns if c not in columns]
    if name.lower() in [c.lower() for c in others]:
        raise ValueError(f"there is a column {name!r} already")
    found = df
    for i, c in enumerate(columns):
        of_column = dictionary.where(F.col("position") == i).select(
            F.col("category").alias(f"_category{i}"), F.col("index").cast("int").alias(f"_index{i}")
        )
        found = found.join(of_column, col(c).cast("string") == F.col(f"_category{i}"), "left")
    indices = F.array_compact(F.array(*[F.col(f"_index{i}") for i in range(len(columns))]))
    vector = F.struct(F.lit(size).alias("size"), indices.alias("indices"), F.transform(indices, lambda _: F.lit(1.0)).alias("values"))
    return found.select(*[col(c) for c in others], vector.alias(name))
