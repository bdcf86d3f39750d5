"""CSV, zip, SQL dump, frames and tables."""

import datetime
import decimal
import os
import random
import zipfile

import pandas
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinseframe.operators import rows as table_rows
from rinseframe.operators import stats
from rinseframe.plans.lineage import new_path
from rinseframe.sources import csv, dump, rejoin, tables
from rinseframe.sources import zip as zips
from rinseframe.sources.sqltypes import spark_type


def write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", newline="") as file:
        file.write(text)
    return path


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_types_and_empty_tokens(spark, tmp_path):
    text = "i,f,b,s,d,e\n1,1.5,True,x,2020-01-01,\nNA,2,false,null,2020-01-02,N/A\n3,1e3,True,N/A,x,\n"
    df = csv.read_csv(spark, write(tmp_path, "t.csv", text))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double", "boolean", "string", "string", "double"]
    assert rows(df) == [
        (1, 1.5, True, "x", "2020-01-01", None),
        (None, 2.0, False, None, "2020-01-02", None),
        (3, 1000.0, True, None, "x", None),
    ]


def test_quoted_separators_quotes_and_line_breaks(spark, tmp_path):
    path = write(tmp_path, "q.csv", 'a;b\n"x;""y""\nz";1\nplain;2\n')
    assert csv.has_quoted_line_breaks(spark, path)
    assert rows(csv.read_csv(spark, path, sep=";")) == [('x;"y"\nz', 1), ("plain", 2)]


def test_given_schema(spark, tmp_path):
    path = write(tmp_path, "s.csv", "a,b\n1,2020-01-01\n2,NA\n")
    df = csv.read_csv(spark, path, schema="n int, d date", multi_line=False)
    assert rows(df) == [(1, datetime.date(2020, 1, 1)), (2, None)]
    with pytest.raises(ValueError):
        csv.read_csv(spark, path, schema="n int")


def test_csv_text_of_cells(spark):
    df = spark.createDataFrame(
        [(1e7, True, None, 'a"b,c', datetime.datetime(2020, 1, 2, 3, 4, 5))],
        "x double, b boolean, n int, s string, t timestamp_ntz",
    )
    path = new_path(spark, "csv")
    csv.write_csv(df, path, empty="?", single_file=True)
    lines = [r["value"] for r in spark.read.text(path).collect()]
    assert lines == ["x,b,n,s,t", '10000000.0,True,?,"a""b,c",2020-01-02 03:04:05']


def test_zip_of_members(spark, tmp_path):
    path = os.path.join(tmp_path, "upload.ZIP")
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr("one.csv", "a,b\n1,x\n2,\n")
        archive.writestr("folder/two.csv", 'c\n"line\nbreak"\n')
    found = tables.load_path(spark, path)
    assert sorted(found) == ["one.csv", "two.csv"]
    assert sorted(rows(found["one.csv"])) == [(1, "x"), (2, None)]
    assert rows(found["two.csv"]) == [("line\nbreak",)]


def test_many_archives(spark, tmp_path):
    for i in range(3):
        with zipfile.ZipFile(os.path.join(tmp_path, f"{i}.zip"), "w") as archive:
            archive.writestr("t.csv", f"a\n{i}\n")
    assert sorted(rows(zips.read_zip(spark, str(tmp_path))["t.csv"])) == [(0,), (1,), (2,)]


DUMP = r"""-- it's a comment; really
/*!40101 SET NAMES utf8 */;
CREATE TABLE IF NOT EXISTS `people` (
  `id` int(11) NOT NULL,
  name varchar(40) DEFAULT NULL,
  born timestamp without time zone,
  score numeric(8, 2),
  ok boolean,
  PRIMARY KEY (`id`)
) ENGINE=InnoDB;
CREATE TABLE public.empty_one (a text);
INSERT INTO `people` VALUES (1, 'Smith, (J); Jr', '2020-01-02 03:04:05', -12.50, true),
 (2,'O\'Neil',NULL,3,false), (3, 'it''s', '0000-00-00 00:00:00', .5, NULL);
INSERT INTO people (name, id) VALUES ('', 4), ('a;
b', 5);
INSERT INTO unknown VALUES (1);
"""


def test_dump(spark, tmp_path):
    found = dump.read_dump(spark, write(tmp_path, "d.sql", DUMP))
    assert sorted(found) == ["empty_one", "people"]
    assert found["empty_one"].count() == 0
    assert sorted(rows(found["people"])) == [
        (1, "Smith, (J); Jr", datetime.datetime(2020, 1, 2, 3, 4, 5), decimal.Decimal("-12.50"), True),
        (2, "O'Neil", None, decimal.Decimal("3.00"), False),
        (3, "it's", datetime.datetime(1, 1, 1), decimal.Decimal("0.50"), None),
        (4, "", None, None, None),
        (5, "a;\nb", None, None, None),
    ]


def test_dump_split_into_small_blocks(spark, tmp_path):
    """Statements glued across block borders."""
    cells = [(i, f"text; {i} it''s; " + "x" * (i % 37) + "\n;") for i in range(400)]
    text = "CREATE TABLE t (i int, s text);\n" + "".join(f"INSERT INTO t VALUES ({i}, '{s}');\n" for i, s in cells)
    path = write(tmp_path, "blocks.sql", text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        found = sorted(rows(dump.read_dump(spark, path)["t"]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found == [(i, s.replace("''", "'")) for i, s in cells]


def test_dump_with_wrong_number_of_values(spark, tmp_path):
    path = write(tmp_path, "w.sql", "CREATE TABLE t (a int, b int);\nINSERT INTO t VALUES (1);\n")
    with pytest.raises(Exception, match="do not match"):
        dump.read_dump(spark, path)["t"].collect()


@pytest.mark.parametrize(
    "declared, expected",
    [
        ("tinyint(1)", T.ShortType()),
        ("MEDIUMINT", T.IntegerType()),
        ("bigserial", T.LongType()),
        ("numeric", T.DecimalType(38, 18)),
        ("decimal(12)", T.DecimalType(12, 0)),
        ("numeric(10, 2)", T.DecimalType(10, 2)),
        ("real", T.FloatType()),
        ("float(8)", T.DoubleType()),
        ("double precision", T.DoubleType()),
        ("smallmoney", T.DecimalType(19, 2)),
        ("character varying(20)", T.StringType()),
        ("longtext", T.StringType()),
        ("bytea", T.BinaryType()),
        ("timestamp (3) with time zone", T.TimestampType()),
        ("timestamp without time zone", T.TimestampNTZType()),
        ("date", T.DateType()),
        ("time (3) without time zone", T.StringType()),
        ("interval day to second", T.StringType()),
        ("boolean", T.BooleanType()),
        ("uuid", T.StringType()),
        ("jsonb", T.StringType()),
    ],
)
def test_declared_types(declared, expected):
    assert spark_type(declared) == expected


def test_unknown_declared_type():
    with pytest.raises(ValueError):
        spark_type("hyperloglog")


def test_load_path(spark, tmp_path):
    path = write(tmp_path, "People.CSV", "a\n1\n")
    assert rows(tables.load_path(spark, path)["People.CSV"]) == [(1,)]
    with pytest.raises(ValueError):
        tables.load_path(spark, "table.xlsx")


def test_from_frame(spark):
    df = tables.from_frame(spark, pd.DataFrame({"x": [1.0, float("nan")], "s": ["a", "b"]}))
    assert rows(df) == [(1.0, "a"), (None, "b")]


def test_replace_refuses_its_own_source(spark):
    path = new_path(spark, "own")
    tables.write_table(spark.range(3), path)
    with pytest.raises(ValueError):
        tables.replace_table(spark.read.parquet(path), path)
    assert tables.replace_table(spark.range(2), path).count() == 2


# ---- quotes that are characters


def pandas_rows(path, columns, **options):
    found = pandas.read_csv(path, dtype=str, **options)
    assert list(found.columns) == columns
    return sorted((tuple(None if pandas.isna(c) else c for c in row) for row in found.itertuples(index=False)), key=repr)


STRAY = {
    "inches": 'a,b\n5",x\n6",y\n7",z\n8,q\n',
    "pipes": 'a,b\n5" pipe,x\n6" pipe,y\n7,z\n',
    "after the end": 'a,b\n"ab"cd,x\n"a""b"" c"d"e,"y"\n',
    "single": 'a,b\n5" one,x\n',
    "both": 'a,b\n5",x\n"line\nbreak, 7""",6"\n8,"z"\n',
    "carriage returns": 'a,b\r\n5",x\r\n"two\r\nlines",y\r\n"8"" ",z\r\n',
    "blanks first": 'a,b\n "x",1\n  5" y," z "\n',
}


@pytest.mark.parametrize("name", STRAY)
@pytest.mark.parametrize("block", [None, 64])
def test_stray_quotes(spark, tmp_path, name, block):
    path = write(tmp_path, "stray.csv", STRAY[name])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if block:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        found = csv.read_csv(spark, path, schema="a string, b string")
        assert sorted(rows(found), key=repr) == pandas_rows(path, ["a", "b"])
        assert found.count() == len(pandas_rows(path, ["a", "b"]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


CELLS = ["", "a", '5"', 'a"b"c', '"x,y"', '"l1\nl2"', '"a""b"', '""""', '"ab"cd', '"ab"c"d"', '"q\n"z"', ' "b" ', '"', "t\tu"]


@pytest.mark.parametrize("seed", range(4))
def test_random_quotes(spark, tmp_path, monkeypatch, seed):
    """Cells with quotes in every place, in blocks of 64 bytes and runs of few blocks, and in a zip."""
    rng = random.Random(seed)
    lines = [",".join(["k", *(rng.choice(CELLS[:-2] + CELLS[-1:]) for _ in range(3))]) for _ in range(120)]
    path = write(tmp_path, "random.csv", "\n".join(["k,a,b,c", *lines]) + "\n")
    schema, expected = "k string, a string, b string, c string", pandas_rows(path, ["k", "a", "b", "c"])
    monkeypatch.setattr(rejoin, "RUN_BYTES", 300)
    monkeypatch.setattr(rejoin, "FEW_BLOCKS", 0 if seed % 2 else 100_000)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        found = csv.read_csv(spark, path, schema=schema)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(rows(found), key=repr) == expected
    with zipfile.ZipFile(os.path.join(tmp_path, "random.zip"), "w") as archive:
        archive.write(path, "random.csv")
    zipped = zips.read_zip(spark, os.path.join(tmp_path, "random.zip"), schema={"random.csv": schema})["random.csv"]
    assert sorted(rows(zipped), key=repr) == expected


@pytest.mark.parametrize("text", ["a,b\n1,x\n2,y\n", 'a,b\n1,"x\ny"\n2,z\n'])
@pytest.mark.parametrize("schema", [None, "a int, b string"])
def test_counts_and_pages(spark, tmp_path, text, schema):
    found = csv.read_csv(spark, write(tmp_path, "c.csv", text), schema=schema)
    assert found.count() == 2 and stats.row_count(found).first()["n"] == 2
    assert found.select("b").count() == 2 and found.where("a = 1").count() == 1
    envelope = table_rows.page_envelope(found, {"draw": 1, "start": 0, "length": 10})
    assert envelope["recordsTotal"] == 2 and len(envelope["data"]) == 2


@pytest.mark.parametrize("head", ["a,a,b", "a,a.1,a", ",b,", 'x,x,x,"x"'])
def test_header_names(spark, tmp_path, head):
    path = write(tmp_path, "h.csv", head + "\n" + ",".join("1" for _ in head.split(",")) + "\n")
    assert csv.read_csv(spark, path).columns == list(pandas.read_csv(path).columns)


def test_surplus_beside_stray_quotes(spark, tmp_path):
    with pytest.raises(Exception, match="more cells than columns"):
        csv.read_csv(spark, write(tmp_path, "s.csv", 'a,b\n5",6",x\n')).count()


def test_zip_members_are_tasks(spark, tmp_path):
    path = os.path.join(tmp_path, "many.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for i in range(20):
            archive.writestr(f"d/m{i}.csv", "a,b\n" + f"{i},x\n" * 10)
        archive.mkdir("empty")
    records = zips.member_records(",", '"', "utf-8-sig")
    spark.dataSource.register(zips.member_source(zips.archive_paths(spark, path), records))
    found = spark.read.format("zip_members").load()
    per_task = found.groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("member").alias("n")).collect()
    assert len(per_task) == 20 and all(r.n == 1 for r in per_task)
    tables_found = zips.read_zip(spark, path)
    assert len(tables_found) == 20 and all(t.count() == 10 for t in tables_found.values())
    with pytest.raises(FileNotFoundError):
        zips.read_zip(spark, str(tmp_path / "none.zip"))
