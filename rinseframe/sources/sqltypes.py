"""Column types declared in SQL dumps, as Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Declared type names and the Spark types they stand for.
PLAIN_TYPES = {
    "tinyint": T.ShortType(),
    "smallint": T.ShortType(),
    "byte": T.ShortType(),
    "mediumint": T.IntegerType(),
    "int": T.IntegerType(),
    "integer": T.IntegerType(),
    "bigint": T.LongType(),
    "smallserial": T.ShortType(),
    "serial": T.IntegerType(),
    "bigserial": T.LongType(),
    "real": T.FloatType(),
    "float": T.DoubleType(),
    "double": T.DoubleType(),
    "double precision": T.DoubleType(),
    "money": T.DecimalType(19, 2),
    "smallmoney": T.DecimalType(19, 2),
    "varchar": T.StringType(),
    "character varying": T.StringType(),
    "char": T.StringType(),
    "character": T.StringType(),
    "text": T.StringType(),
    "tinytext": T.StringType(),
    "mediumtext": T.StringType(),
    "longtext": T.StringType(),
    "bytea": T.BinaryType(),
    "date": T.DateType(),
    "boolean": T.BooleanType(),
    "point": T.StringType(),
    "line": T.StringType(),
    "lseg": T.StringType(),
    "box": T.StringType(),
    "path": T.StringType(),
    "polygon": T.StringType(),
    "circle": T.StringType(),
    "cidr": T.StringType(),
    "inet": T.StringType(),
    "macaddr": T.StringType(),
    "uuid": T.StringType(),
    "bit": T.StringType(),
    "bit varying": T.StringType(),
    "xml": T.StringType(),
    "json": T.StringType(),
    "jsonb": T.StringType(),
    "tsquery": T.StringType(),
    "tsvector": T.StringType(),
    "interval": T.StringType(),
    "time": T.StringType(),
}


def spark_type(declared: str) -> T.DataType:
    """The Spark type of a declaration such as ``numeric(12, 2)`` or ``varchar(20)``."""
    text = re.sub(r"\s+", " ", declared.strip().lower())
    arguments = [int(n) for n in re.findall(r"\d+", "".join(re.findall(r"\(([^)]*)\)", text)).replace(",", " "))]
    name = re.sub(r"\s*\([^)]*\)\s*", " ", text).strip()
    if name in ("decimal", "numeric"):
        if not arguments:
            return T.DecimalType(38, 18)
        return T.DecimalType(arguments[0], arguments[1] if len(arguments) > 1 else 0)
    if re.fullmatch(r"timestamp( with(out)? time zone)?", name):
        return T.TimestampType() if name.endswith("with time zone") else T.TimestampNTZType()
    if re.fullmatch(r"time( with(out)? time zone)?", name) or name.startswith("interval "):
        return T.StringType()
    if name in PLAIN_TYPES:
        return PLAIN_TYPES[name]
    raise ValueError(f"unknown SQL data type {declared!r}")
