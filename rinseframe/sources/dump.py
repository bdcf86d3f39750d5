"""SQL dumps: CREATE TABLE and INSERT INTO .. VALUES statements of a text file."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinseframe.plans.lineage import new_path
from rinseframe.sources.rejoin import CODE, read_pieces, rejoin
from rinseframe.sources.sqltypes import spark_type

# Parts of the statements, with possessive repeats so that no text is too long.
QUOTED = r"'(?:[^'\\]++|\\.|'')*+'"
TUPLE = rf"(?s)\((?:[^()']++|{QUOTED}|\([^()']*+\))*+\)"
VALUE = rf"(?s)\s*+((?:[^,()']++|{QUOTED}|\([^()']*+\))++)(?:,|$)"
NAME = r"[\"'`]?(\w[\w$]*)[\"'`]?"
START = r"(?is)^\s*+"
CREATE = rf"{START}CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:{NAME}\.)?{NAME}\s*\("
INSERT = rf"{START}INSERT\s+INTO\s+(?:{NAME}\.)?{NAME}\s*(?:\(([^()]*)\))?\s*VALUES"
# Words opening a line of CREATE TABLE that declares no column.
NOT_COLUMNS = {"primary", "key", "unique", "constraint", "index", "foreign", "check", "fulltext", "spatial", "exclude"}


# States a place of a dump can be in: code, or inside a quoted text, name or comment.
TEXT, DOUBLE, BACKTICK, BLOCK, LINE = range(CODE + 1, CODE + 6)
OPENS = {"'": TEXT, '"': DOUBLE, "`": BACKTICK, "/*": BLOCK, "--": LINE, "#": LINE}
OPENING = re.compile(r"""'|"|`|/\*|--|#""")
CLOSING = {
    TEXT: re.compile(r"(?s)[^'\\]*+(?:\\.[^'\\]*+)*+'"),
    DOUBLE: re.compile(r'(?s)[^"\\]*+(?:\\.[^"\\]*+)*+"'),
    BACKTICK: re.compile(r"[^`]*+`"),
    BLOCK: re.compile(r"(?s).*?\*/"),
    LINE: re.compile(r"[^\n]*+\n"),
}


def read_through(piece: str, state: int, uncommented: bool) -> tuple[int, str]:
    """The state after a piece of a dump, and the piece with blanks for its comments if asked for."""
    at, kept = 0, []
    while at < len(piece):
        if state == CODE:
            found = OPENING.search(piece, at)
            end = found.end() if found else len(piece)
            following = OPENS[found[0]] if found else CODE
            if uncommented:
                kept.append(piece[at : found.start() if following in (BLOCK, LINE) else end])
        else:
            found = CLOSING[state].match(piece, at)
            end = found.end() if found else len(piece)
            following = CODE if found else state
            if uncommented:
                kept.append(piece[at:end] if state not in (BLOCK, LINE) else " ")
        at, state = end, following
    return state, "".join(kept)


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """(statement): the file cut at semicolons outside quotes and comments, without its comments.

    A quote or block comment open at the end of a file is an error.
    """
    pieces = read_pieces(spark, path, ";")
    found = rejoin(pieces, read_through, CODE + 6, ";", may_end_in=(CODE, LINE), left_out=(BLOCK, LINE))
    return found.select(F.col("record").alias("statement"))


def parse_columns(declarations: str) -> list[tuple[str, str]]:
    """(name, declared type) of the columns in the rest of CREATE TABLE after its parenthesis."""
    columns, depth, closed = [], 1, len(declarations)
    for position, character in enumerate(declarations):
        depth += (character == "(") - (character == ")")
        if depth == 0:
            closed = position
            break
    for line in re.split(r",(?![^(]*\))", declarations[:closed]):
        match = re.match(r"\s*([\"'`]?)(\w[\w$]*)\1\s+(.+)", line, re.S)
        if not match or (not match.group(1) and match.group(2).lower() in NOT_COLUMNS):
            continue
        declared = re.match(
            r"(?i)(character varying|bit varying|double precision|"
            r"(?:timestamp|time)(?:\s*\(\d+\))?\s+with(?:out)?\s+time\s+zone|"
            r"interval(?:\s+(?:year|month|day|hour|minute|second)(?:\s+to\s+(?:month|hour|minute|second))?)?|\w+)"
            r"(\s*\([^)]*\))?",
            match.group(3).strip(),
        )
        columns.append((match.group(2), declared.group(0)))
    return columns


def _cell(text: Column, dtype: T.DataType) -> Column:
    """A value of an INSERT tuple as the declared type."""
    raw = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    inner = F.regexp_extract(raw, rf"(?s)({QUOTED})", 1)
    inner = F.substr(inner, F.lit(2), F.length(inner) - 2)
    inner = F.replace(F.replace(inner, F.lit("\\'"), F.lit("'")), F.lit("''"), F.lit("'"))
    inner = F.regexp_replace(inner, "^0000-00-00", "0001-01-01") if isinstance(
        dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)
    ) else inner
    value = F.when(F.upper(raw).isin("NULL", "DEFAULT"), F.lit(None)).when(raw.contains("'"), inner).otherwise(raw)
    if isinstance(dtype, T.StringType):
        return value
    if isinstance(dtype, T.BinaryType):
        return F.when(value.startswith("\\x"), F.unhex(F.substr(value, F.lit(3)))).otherwise(value.cast("binary"))
    if dtype == T.DecimalType(19, 2):
        value = F.regexp_replace(value, "[$,]", "")
    return value.cast(dtype)


def read_dump(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Table name to table, for every table the dump creates.

    Statements are cut once and kept; the tuples of all INSERT statements are then
    written once, one folder per table.
    """
    statements = read_statements(spark, path)
    created = statements.where(F.col("statement").rlike(CREATE)).select(
        F.regexp_extract("statement", CREATE, 2).alias("name"),
        F.regexp_replace("statement", CREATE, "").alias("body"),
    )
    # one row per table of the dump
    declared = {r["name"]: parse_columns(r["body"]) for r in created.collect()}
    head = F.regexp_extract("statement", INSERT, 0)
    body = F.substr("statement", F.length("head") + 1)
    listed = F.regexp_extract_all(F.regexp_extract("head", INSERT, 3), F.lit(r"(\w[\w$]*)"), F.lit(1))
    inserts = (
        statements.select("statement", head.alias("head"))
        .where(F.col("head") != "")
        .select(
            F.regexp_extract("head", INSERT, 2).alias("name"),
            listed.alias("listed"),
            F.explode(F.regexp_extract_all(body, F.lit(TUPLE), F.lit(0))).alias("tuple"),
        )
        .where(F.col("name").isin(list(declared)))
    )
    if not declared:
        return {}
    tuples = new_path(spark, "dump")
    inserts.write.partitionBy("name").parquet(tuples)
    schema = "listed array<string>, tuple string, name string"
    stored = spark.read.schema(schema).parquet(tuples)
    return {name: _table(stored.where(F.col("name") == name), columns) for name, columns in declared.items()}


def _table(inserts: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    names = F.array(*[F.lit(n) for n, _ in columns])
    body = F.substr("tuple", F.lit(2), F.length("tuple") - 2)
    rows = inserts.select(
        F.when(F.size("listed") > 0, F.col("listed")).otherwise(names).alias("names"),
        F.regexp_extract_all(body, F.lit(VALUE), F.lit(1)).alias("cells"),
    )
    wrong = F.raise_error(F.concat(F.lit("values do not match columns: "), F.col("cells").cast("string")))
    cells = F.when(F.size("cells") == F.size("names"), F.col("cells")).otherwise(wrong.cast("array<string>"))
    rows = rows.select(F.map_from_arrays("names", cells).alias("cell"))
    return rows.select(
        *[_cell(F.col("cell")[n], spark_type(t)).alias(n) for n, t in columns]
    )
