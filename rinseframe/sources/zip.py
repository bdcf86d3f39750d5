"""Zip archives of CSV files: every member is one table."""

from __future__ import annotations

import csv
import io
import os
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rinseframe.plans.lineage import new_path
from rinseframe.sources.csv import NA_TOKENS, empty_tokens_to_null, header_names, parse_records, record_step, typed

RECORDS = "archive string, no long, record string, member string"
BATCH = 10_000


def member_records(sep: str, quote: str, encoding: str) -> Callable[[zipfile.ZipFile, zipfile.ZipInfo], Iterator[tuple[int, str]]]:
    """The numbered CSV records of a member, read as a stream. A record goes on over line breaks inside quoted cells."""
    step = record_step(sep, quote)

    # nested, so that executors need nothing of this package
    def records(archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> Iterator[tuple[int, str]]:
        number, parts, state = 0, [], 0
        with io.TextIOWrapper(archive.open(info), encoding=encoding, newline="\n") as lines:
            for line in lines:
                state, kept = step(line.removesuffix("\n"), state, True)
                parts.append(kept)
                if state:
                    continue
                record = "\n".join(parts).removesuffix("\r")
                parts = []
                if record:
                    yield number, record
                    number += 1
            if state:
                raise ValueError(f"a quote is left open at the end of {info.filename!r}")

    return records


def unzip_records(archives: DataFrame, quote: str = '"', encoding: str = "utf-8-sig", sep: str = ",") -> DataFrame:
    """CSV records of the archives in a (path, content) table; one archive is the unit of work.

    Members are streamed out in batches.
    """
    columns, batch_rows, records = ["archive", "no", "record", "member"], BATCH, member_records(sep, quote, encoding)

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = []
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as archive:
                    for info in archive.infolist():
                        for number, record in records(archive, info) if not info.is_dir() else ():
                            rows.append((path, number, record, os.path.basename(info.filename)))
                            if len(rows) == batch_rows:
                                yield pd.DataFrame(rows, columns=columns)
                                rows = []
                yield pd.DataFrame(rows, columns=columns)

    return archives.select("path", "content").mapInPandas(unzip, RECORDS)


def archive_paths(spark: SparkSession, path: str) -> list[str]:
    """The archives of a file or folder as URIs that ``pyarrow.fs`` opens."""
    given = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = given.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(given).toString()
    files, root = fs.FileSystem.from_uri(f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    info = files.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [i for i in files.get_file_info(fs.FileSelector(root)) if i.is_file]
    scheme = uri.split(":", 1)[0]
    prefix = "file://" if scheme == "file" else uri[: uri.index("/", len(scheme) + 3)] if files.type_name == "hdfs" else f"{scheme}://"
    return sorted(prefix + i.path for i in found if not os.path.basename(i.path).startswith((".", "_")))


def member_source(paths: list[str], records: Callable) -> type[DataSource]:
    """A source of records with a partition for each member of the archives, listed by their central directories.

    A task opens its archive at the member's place and streams it, so archives may have any size.
    """
    batch_rows = BATCH

    class Member(InputPartition):
        def __init__(self, path: str, index: int):
            self.path, self.index = path, index

    class Members(DataSourceReader):
        def partitions(self):
            found = []
            for path in paths:
                files, place = fs.FileSystem.from_uri(path)
                with files.open_input_file(place) as source, zipfile.ZipFile(source) as archive:
                    found += [Member(path, i) for i, info in enumerate(archive.infolist()) if not info.is_dir()]
            return found or [Member("", -1)]

        def read(self, partition):
            if partition.index < 0:
                return
            files, place = fs.FileSystem.from_uri(partition.path)
            with files.open_input_file(place) as source, zipfile.ZipFile(source) as archive:
                info, rows = archive.infolist()[partition.index], []
                for row in records(archive, info):
                    rows.append(row)
                    if len(rows) == batch_rows:
                        yield self.batch(partition.path, info, rows)
                        rows = []
                if rows:
                    yield self.batch(partition.path, info, rows)

        def batch(self, path, info, rows):
            numbers, texts = zip(*rows)
            member = os.path.basename(info.filename)
            columns = [pa.array([path] * len(rows)), pa.array(numbers, pa.int64()), pa.array(texts), pa.array([member] * len(rows))]
            return pa.RecordBatch.from_arrays(columns, names=["archive", "no", "record", "member"])

    class ZipMembers(DataSource):
        @classmethod
        def name(cls):
            return "zip_members"

        def schema(self):
            return RECORDS

        def reader(self, schema):
            return Members()

    return ZipMembers


def read_archives(
    archives: DataFrame,
    sep: str = ",",
    na_tokens: list[str] = NA_TOKENS,
    quote: str = '"',
    header: bool = True,
    schema: dict[str, T.StructType | str] | None = None,
    encoding: str = "utf-8-sig",
) -> dict[str, DataFrame]:
    """Member name to table. Members of one name in several archives form one table.

    Every archive is unzipped once, into a table with a folder for each member. Types are
    inferred from all rows, but for members that ``schema`` names.
    """
    return tables_of(unzip_records(archives, quote, encoding, sep), sep, na_tokens, quote, header, schema)


def tables_of(
    found: DataFrame, sep: str, na_tokens: list[str], quote: str, header: bool, schema: dict[str, T.StructType | str] | None
) -> dict[str, DataFrame]:
    """Member name to table, from records stored in a folder for each member."""
    spark = found.sparkSession
    path = new_path(spark, "unzipped")
    found.write.partitionBy("member").parquet(path)
    stored = spark.read.schema(RECORDS).parquet(path)
    tables: dict[str, DataFrame] = {}
    options = {"sep": sep, "quote": quote, "escape": quote}
    # a header for each member name
    for row in stored.where("no = 0").select("member", "record").distinct().orderBy("member").collect():
        cells = next(csv.reader([row["record"]], delimiter=sep, quotechar=quote))
        names = header_names(cells) if header else [f"_c{i}" for i in range(len(cells))]
        if row["member"] in tables:
            if tables[row["member"]].columns != names or header:
                raise ValueError(f"archives disagree about the header of {row['member']!r}")
            continue
        records = stored.where(F.col("member") == row["member"])
        text = parse_records(records.where("no > 0") if header else records, names, options)
        tables[row["member"]] = typed(empty_tokens_to_null(text, na_tokens), (schema or {}).get(row["member"]))
    return tables


def read_zip(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    na_tokens: list[str] = NA_TOKENS,
    quote: str = '"',
    header: bool = True,
    schema: dict[str, T.StructType | str] | None = None,
    encoding: str = "utf-8-sig",
) -> dict[str, DataFrame]:
    """Tables of one archive, or of a folder of archives; every member is a task of its own.

    In a store that only Spark reads, every archive is a task and has at most 2 GB.
    """
    try:
        paths = archive_paths(spark, path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):  # no such file system in pyarrow
        archives = spark.read.format("binaryFile").load(path).select("path", "content")
        return read_archives(archives, sep, na_tokens, quote, header, schema, encoding)
    spark.dataSource.register(member_source(paths, member_records(sep, quote, encoding)))
    return tables_of(spark.read.format("zip_members").load(), sep, na_tokens, quote, header, schema)
