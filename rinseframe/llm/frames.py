"""Shared helpers of the training-data operators: names, stored tables, numbering.

``stored`` writes a table below ``spark.checkpoint.dir`` and frees the shuffle files
behind it, so a chain of stages holds one stage's shuffle on disk at a time.
``Scratch`` removes the stored tables that the result no longer needs; ``remembered`` tells which
calls left tables for a result, so that they can be removed when it has been written.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rinseframe.plans.lineage import new_path

#: while a table is stored: shuffles end with the write, and Python gets batches of bounded size
WHILE_STORING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


REMEMBERING: list[list[Scratch]] = []


@contextmanager
def remembered(scratches: list[Scratch]) -> Iterator[None]:
    """Add every operator call made within to the list."""
    REMEMBERING.append(scratches)
    try:
        yield
    finally:
        REMEMBERING.remove(scratches)


class Scratch:
    """Stored tables of one operator call. ``drop`` removes one as soon as nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}
        self.names: dict[int, str] = {}
        for opened in REMEMBERING:
            opened.append(self)

    def stored(self, df: DataFrame, label: str = "llm") -> DataFrame:
        path = new_path(self.spark, label)
        with settings(self.spark, WHILE_STORING):
            df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = path
        table._scratch = self  # keeps the id from being reused while the table is in use
        return table

    def bucketed(self, df: DataFrame, by: str, buckets: int, label: str) -> DataFrame:
        """Store a table whose rows of a ``by`` value lie together, so that grouping by it needs no shuffle."""
        path = new_path(self.spark, label)
        name = path.rsplit("/", 1)[1].replace("-", "_")
        with settings(self.spark, WHILE_STORING):
            dealt = df.repartition(buckets, by)
            dealt.write.bucketBy(buckets, by).sortBy(by).format("parquet").option("path", path).saveAsTable(name)
        table = self.spark.table(name)
        self.paths[id(table)], self.names[id(table)] = path, name
        table._scratch = self
        return table

    def renamed(self, table: DataFrame, view: DataFrame) -> DataFrame:
        """Let a view of a stored table stand for it."""
        self.paths[id(view)] = self.paths.pop(id(table))
        view._scratch = self
        return view

    def drop(self, *tables: DataFrame) -> None:
        self.remove([id(table) for table in tables])

    def release(self) -> None:
        """Remove all tables that are left; nothing may read them any more."""
        self.remove(list(self.paths))

    def remove(self, keys: list[int]) -> None:
        for key in keys:
            path, name = self.paths.pop(key, None), self.names.pop(key, None)
            if name:
                self.spark.sql(f"DROP TABLE IF EXISTS `{name}`")
            if path:
                there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                there.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(there, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop the columns of these names, in any case, before columns of these names are added."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def all_equal(left: list[Column], right: list[Column]) -> Column:
    """Equality in all columns, where null equals null."""
    result = F.lit(True)
    for a, b in zip(left, right):
        result = result & a.eqNullSafe(b)
    return result


def with_rows(df: DataFrame, scratch: Scratch, row: str) -> DataFrame:
    """Store the rows under a number that also tells the partition that wrote them."""
    return scratch.stored(df.withColumn(row, F.monotonically_increasing_id()), "rows")


def number(table: DataFrame, row: str, by: str, name: str) -> DataFrame:
    """Number the rows of each ``by`` group from 0 without gaps, never a whole group in one task.

    ``table`` comes from ``with_rows``. Each (group, writing partition) pair is numbered by
    itself, and the running sum of the pairs' counts gives where its numbers start, so a
    group of any size is spread over all partitions. The join keeps the partitioning of the
    numbering: whole rows are shuffled once. Rows without a group get no number.
    """
    part, base = fresh(table, "part"), fresh(table, "base")
    parted = table.withColumn(part, F.shiftright(row, 33))
    counts = parted.where(F.col(by).isNotNull()).groupBy(by, part).agg(F.count("*").alias(base))
    before = Window.partitionBy(by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(by, part, F.coalesce(F.sum(base).over(before), F.lit(0)).alias(base))
    local = F.row_number().over(Window.partitionBy(by, part).orderBy(row)) - 1
    joined = parted.withColumn(name, local).join(starts, [by, part], "left")
    kept = [F.col(f"`{c}`") for c in table.columns if c != row]
    return joined.select(*kept, (F.col(base) + F.col(name)).alias(name))


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """Number the rows of each ``by`` group; an input column of that name is replaced."""
    df = without(df, name)
    row = fresh(df, "row")
    return number(with_rows(df, Scratch(df.sparkSession), row), row, by, name)
