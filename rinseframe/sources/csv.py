"""CSV in and out."""

from __future__ import annotations

import csv
import os
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinseframe.functions.columns import col, replace_columns
from rinseframe.functions.text import cell_text
from rinseframe.sources.rejoin import CODE, read_pieces, rejoin

# Cell texts read as empty.
NA_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# How numbers and truth values are written in a cell.
INTEGER_TEXT = r"^\s*[+-]?[0-9]+\s*$"
NUMBER_TEXT = r"^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"
TRUTH_TEXT = ["True", "TRUE", "true", "False", "FALSE", "false"]


def table_name(path: str) -> str:
    """A table is named after its file, extension included."""
    return os.path.basename(path.rstrip("/"))


def empty_tokens_to_null(df: DataFrame, tokens: list[str] = NA_TOKENS) -> DataFrame:
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return replace_columns(df, {n: F.when(~col(n).isin(tokens), col(n)) for n in strings})


def infer_types(df: DataFrame) -> DataFrame:
    """Give all-text columns the type every one of their cells can be read as.

    Whole numbers, then numbers, then truth values, else text; dates stay text.
    One aggregate over all rows and columns.
    """

    def whole(c: Column) -> Column:
        return c.rlike(INTEGER_TEXT) & F.trim(c).try_cast("bigint").isNotNull()

    checks = []
    for i, name in enumerate(df.columns):
        c = col(name)
        checks += [
            F.count(c).alias(f"{i}_n"),
            F.count_if(whole(c)).alias(f"{i}_int"),
            F.count_if(c.rlike(NUMBER_TEXT)).alias(f"{i}_num"),
            F.count_if(c.isin(TRUTH_TEXT)).alias(f"{i}_bool"),
        ]
    row = df.agg(*checks).first()
    exprs = {}
    for i, name in enumerate(df.columns):
        n = row[f"{i}_n"]
        if n == 0:  # nothing but empty cells
            exprs[name] = F.lit(None).cast("double")
        elif row[f"{i}_int"] == n:
            exprs[name] = F.trim(col(name)).cast("bigint")
        elif row[f"{i}_num"] == n:
            exprs[name] = F.trim(col(name)).cast("double")
        elif row[f"{i}_bool"] == n:
            exprs[name] = F.lower(col(name)).cast("boolean")
    return replace_columns(df, exprs)


def cell_patterns(sep: str, quote: str) -> tuple[str, str]:
    """A cell in quotes, and the characters of one without: a quote counts only at the start of a cell."""
    q, other = re.escape(quote), f"[^{re.escape(sep)}]" if len(sep) == 1 else f"(?s:(?!{re.escape(sep)}).)"
    return f"{q}(?:[^{q}]++|{q}{q})*+{q}", f"{other}*+"


def has_quoted_line_breaks(spark: SparkSession, path: str, quote: str = '"', sep: str = ",") -> bool:
    """Whether some line ends inside a quoted cell, or has text between a closing quote and the next separator."""
    quoted, plain = cell_patterns(sep, quote)
    cell = f"(?:{quoted}|(?!{re.escape(quote)}){plain})"
    whole = f"^{cell}(?:{re.escape(sep)}{cell})*+\\r?$"
    return not spark.read.text(path).where(F.contains("value", F.lit(quote)) & ~F.col("value").rlike(whole)).isEmpty()


QUOTED = CODE + 1


def record_step(sep: str, quote: str) -> Callable[[str, int, bool], tuple[int, str]]:
    """What a line does to the state, CODE or QUOTED, and the line with cells in regular quotes.

    A quote opens a cell at its start only; anywhere else in a cell without quotes it is
    a character, and text after the closing quote belongs to the cell.
    """
    inside_after, twice = QUOTED, quote + quote

    # nested, so that executors need nothing of this package
    def step(line: str, state: int, wanted: bool) -> tuple[int, str]:
        if quote not in line:
            return state, line
        kept, at, inside = [], 0, state == inside_after
        end = len(line) - line.endswith("\r")
        while True:
            begin = at
            if inside or line.startswith(quote, at):
                close = line.find(quote, at if inside else at + 1)
                while close >= 0 and line.startswith(quote, close + 1):
                    close = line.find(quote, close + 2)
                if close < 0:
                    kept.append(line[begin:])
                    return inside_after, "".join(kept)
                inside = False
                stop = line.find(sep, close + 1)
                rest = line[close + 1 : end if stop < 0 else stop]
                kept.append(line[begin:close] + rest.replace(quote, twice) + quote)
            else:
                stop = line.find(sep, at)
                cell = line[at : end if stop < 0 else stop]
                kept.append(quote + cell.replace(quote, twice) + quote if quote in cell else cell)
            if stop < 0:
                return 0, "".join(kept)
            kept.append(sep)
            at = stop + len(sep)

    return step


def read_records(spark: SparkSession, path: str, quote: str, sep: str = ",") -> DataFrame:
    """(record, first): lines joined where a quote is open, in parallel; ``first`` marks each file's header."""
    records = rejoin(read_pieces(spark, path, "\n"), record_step(sep, quote), QUOTED + 1, "\n")
    return records.withColumn("record", F.regexp_replace("record", "\r$", "")).where("record <> '' OR first")


def header_names(cells: list[str]) -> list[str]:
    """Column names: a repeated one gets the first free number after a dot, an empty one its place."""
    names: list[str] = []
    for i, cell in enumerate(cells):
        name, number = cell or f"Unnamed: {i}", 0
        base = name
        while name in names or (number and name in cells):
            number += 1
            name = f"{base}.{number}"
        names.append(name)
    return names


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of some file of the path."""
    row = spark.read.text(path).where("_metadata.file_block_start = 0").first()
    return row and row["value"].removesuffix("\r")


def odd_column(names: list[str]) -> str:
    """A column for the text of rows that have another number of cells than there are columns."""
    odd = "odd_record"
    while odd.lower() in [n.lower() for n in names]:
        odd += "_"
    return odd


def without_surplus(parsed: DataFrame, names: list[str], sep: str, quote: str) -> DataFrame:
    """The columns of parsed rows; a row with more cells than columns is an error."""
    odd = odd_column(names)
    quoted, plain = cell_patterns(sep, quote)
    # one mark for each cell
    marks = F.regexp_replace(F.concat(F.lit(sep), col(odd)), f"{re.escape(sep)}(?:{quoted})?+{plain}", "x")
    cells = F.length(marks)
    # names the first cell, as a reader gives no rows where nothing but the odd text is asked for
    surplus = F.concat(F.lit("more cells than columns after "), F.coalesce(col(names[0]), F.lit("")), F.lit(": "), col(odd))
    surplus = F.raise_error(surplus).cast("boolean")
    fitting = F.when(col(odd).isNull() | (cells <= len(names)), F.lit(True)).otherwise(surplus)
    return parsed.where(fitting).select(*[col(n) for n in names])


def parse_records(records: DataFrame, names: list[str], options: dict[str, str]) -> DataFrame:
    """The cells of whole CSV records as text columns."""
    odd = odd_column(names)
    ddl = ", ".join([f"c{i} string" for i in range(len(names))] + ["odd string"])
    parsed = records.select(F.from_csv("record", ddl, {**options, "columnNameOfCorruptRecord": "odd"}).alias("r"))
    return without_surplus(parsed.select("r.*").toDF(*names, odd), names, options["sep"], options["quote"])


def typed(text: DataFrame, schema: T.StructType | str | None) -> DataFrame:
    """Text columns with the types and names of a schema, or with inferred types."""
    if schema is None:
        return infer_types(text)
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if len(wanted.fields) != len(text.columns):
        raise ValueError(f"the schema has {len(wanted.fields)} columns, the file {len(text.columns)}")
    return text.select(
        *[F.trim(col(n)).cast(f.dataType).alias(f.name) if not isinstance(f.dataType, T.StringType) else col(n).alias(f.name)
          for n, f in zip(text.columns, wanted.fields)]
    )


def read_csv(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    quote: str = '"',
    header: bool = True,
    schema: T.StructType | str | None = None,
    na_tokens: list[str] = NA_TOKENS,
    multi_line: bool | None = None,
    encoding: str = "UTF-8",
) -> DataFrame:
    """A CSV file or folder with a header line.

    Types are inferred from all rows unless ``schema`` is given. ``multi_line`` left open is
    decided by looking for quoted line breaks and text after closing quotes; give both to read
    very large files in a single pass. A quote inside a cell without quotes is a character. Files with quoted line breaks are split among tasks like others, except in
    encodings other than UTF-8. A row with fewer cells than the header is filled with empty
    cells, one with more is an error.
    """
    if multi_line is None:
        multi_line = has_quoted_line_breaks(spark, path, quote, sep)
    options = {"sep": sep, "quote": quote, "escape": quote, "encoding": encoding}
    plain = encoding.upper().replace("-", "") == "UTF8"
    reader = spark.read.options(**options).option("header", header).option("multiLine", multi_line)
    records = read_records(spark, path, quote, sep) if multi_line and plain else None
    if not plain:
        names = reader.csv(path).columns
    else:
        head = records.where("first").first() if records is not None else None
        line = (head and head["record"]) if records is not None else first_line(spark, path)
        cells = next(csv.reader([line], delimiter=sep, quotechar=quote, strict=False), [""]) if line and len(sep) == 1 else None
        if cells is None:
            names = reader.csv(path).columns
        else:
            names = header_names(cells) if header else [f"_c{i}" for i in range(len(cells))]
    if not names:
        raise ValueError(f"{path!r} holds no columns")
    if records is not None:
        parsed = parse_records(records.where("NOT first") if header else records, names, options)
    else:
        odd = odd_column(names)
        strings = T.StructType([T.StructField(n, T.StringType()) for n in [*names, odd]])
        parsed = reader.option("columnNameOfCorruptRecord", odd).schema(strings).csv(path)
        parsed = without_surplus(parsed, names, sep, quote)
    return typed(empty_tokens_to_null(parsed, na_tokens), schema)


def write_csv(df: DataFrame, path: str, sep: str = ",", empty: str = "", single_file: bool = False) -> None:
    """Write a folder of CSV parts with a header and no row index.

    ``single_file`` funnels everything through one task, so ask for it only for
    a result known to be small.
    """
    text = df.select(*[cell_text(df, n).alias(n) for n in df.columns])
    text = text.coalesce(1) if single_file else text
    (
        text.write.option("header", True)
        .option("sep", sep)
        .option("escape", '"')
        .option("nullValue", empty)
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
