"""Loading by extension, in-memory frames, and Parquet tables."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from rinseframe.functions.columns import nan_to_null
from rinseframe.sources.csv import read_csv, table_name
from rinseframe.sources.dump import read_dump
from rinseframe.sources.zip import read_zip


def load_path(spark: SparkSession, path: str, **options) -> dict[str, DataFrame]:
    """Tables of a ``.csv``, ``.zip``, ``.sql`` or ``.parquet`` file, by name."""
    extension = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if extension == "csv":
        return {table_name(path): read_csv(spark, path, **options)}
    if extension == "zip":
        return read_zip(spark, path, **options)
    if extension in ("sql", "parquet") and options:
        raise ValueError(f"a .{extension} file takes no options, given {sorted(options)}")
    if extension == "sql":
        return read_dump(spark, path)
    if extension == "parquet":
        return {table_name(path): scan(spark, path)}
    raise ValueError(f"cannot load {path!r}: expected .csv, .zip, .sql or .parquet")


def from_frame(spark: SparkSession, frame: pd.DataFrame) -> DataFrame:
    """A pandas frame already on the driver as a table, its NaN as empty cells."""
    return nan_to_null(spark.createDataFrame(frame))


def scan(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Materialise a table at a new path and read it back."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def copy_table(spark: SparkSession, source: str, target: str) -> tuple[DataFrame, dict[str, str]]:
    """Copy a stored table; also returns which old column became which new one."""
    copied = write_table(spark.read.parquet(source), target)
    return copied, {name: name for name in copied.columns}


def path_parts(path: str) -> list[str]:
    """The folders of a path, without its file system."""
    return [p for p in re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path).split("/") if p not in ("", ".")]


def reads_from(df: DataFrame, path: str) -> bool:
    """Whether the rows come from files at or below a path, by the root paths of the plan's relations."""
    target = path_parts(path)
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() != "LogicalRelation":
            continue
        relation = leaf.relation()
        if relation.getClass().getSimpleName() != "HadoopFsRelation":
            continue
        roots = relation.location().rootPaths()
        for k in range(roots.size()):
            source = path_parts(roots.apply(k).toString())
            if source[: len(target)] == target or target[: len(source)] == source:
                return True
    return False


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Overwrite a stored table, refused where the new rows are read from that same path."""
    if reads_from(df, path):
        raise ValueError("a table cannot be overwritten by rows read from it; write to a new path")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
