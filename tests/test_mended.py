"""Golden cases for inputs that once lost or changed data."""

import decimal
import os

import pytest

from rinseframe.operators import dedupe, encode, rows, scale, types, values
from rinseframe.plans import versions
from rinseframe.plans.lineage import new_path
from rinseframe.plans.queries import QUERIES
from rinseframe.sources import csv, dump, tables

SF = "/root/testdata/sf0.001"


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8", newline="") as out:
        out.write(text)
    return path


@pytest.fixture(params=["128m", "40"])
def block_bytes(spark, request):
    """Files whole and cut into tiny blocks."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


# ---- dumps


@pytest.mark.parametrize("comment", ["/* it's */", "# don't\n", "-- user's; id\n", "/*; it's\n' */", "--\n", "", "/**/"])
def test_apostrophes_in_comments(spark, tmp_path, block_bytes, comment):
    text = f"""CREATE TABLE t (a int, {comment} b text {comment});
{comment}
INSERT INTO t VALUES (1, 'x;''y -- # /* '), {comment} (2, '\\'');
{comment}CREATE TABLE u (a int);
INSERT INTO u VALUES (3); {comment}
INSERT INTO t (b, a) VALUES ('/* no */ comment', 4);
INSERT INTO u VALUES (5){comment}"""
    found = dump.read_dump(spark, write(tmp_path, "d.sql", text))
    assert collected(found["t"]) == [(1, "x;'y -- # /* "), (2, "'"), (4, "/* no */ comment")]
    assert collected(found["u"]) == [(3,), (5,)]


@pytest.mark.parametrize("rest", ["'", "/* open", "(3, 'x;\n);\n"])
def test_open_quotes_are_an_error(spark, tmp_path, rest):
    path = write(tmp_path, "open.sql", f"CREATE TABLE t (a int);\nINSERT INTO t VALUES (1);\nINSERT INTO t VALUES {rest}")
    with pytest.raises(Exception, match="left open"):
        dump.read_dump(spark, path)


# ---- CSV


def test_blanks_survive(spark, tmp_path):
    cells = [("  lead",), ("trail  ",), ("a,b ",), (" \t",), ("\nx\n",), ('"q" ',)]
    path = os.path.join(tmp_path, "blanks")
    csv.write_csv(spark.createDataFrame([(*c, i) for i, c in enumerate(cells)], "s string, i int"), path)
    assert collected(csv.read_csv(spark, path)) == sorted(((*c, i) for i, c in enumerate(cells)), key=repr)


def test_records_over_many_lines(spark, tmp_path, block_bytes):
    lines = [f'{i},"line {i}\n\nnext ""{i}"", {"x" * (i % 50)}\n",{i / 2}' for i in range(200)]
    path = write(tmp_path, "many.csv", "i,s,x\r\n" + "\r\n".join(lines) + "\r\n")
    found = {r["i"]: (r["s"], r["x"]) for r in csv.read_csv(spark, path).collect()}
    assert found == {i: (f'line {i}\n\nnext "{i}", {"x" * (i % 50)}\n', i / 2) for i in range(200)}


@pytest.mark.parametrize("row", ["2,y,EXTRA", "2,y,", '2,"y\n",z'])
def test_surplus_cells_are_an_error(spark, tmp_path, row):
    path = write(tmp_path, "wide.csv", f"a,b\n1,x\n{row}\n")
    with pytest.raises(Exception, match="more cells than columns"):
        csv.read_csv(spark, path).collect()


def test_short_rows_are_filled(spark, tmp_path):
    assert collected(csv.read_csv(spark, write(tmp_path, "short.csv", "a,b\n1,x\n2\n"))) == [(1, "x"), (2, None)]


def test_infinite_numbers(spark, tmp_path):
    df = csv.read_csv(spark, write(tmp_path, "inf.csv", "a\n1\ninf\n-Infinity\n3\n"))
    assert dict(df.dtypes) == {"a": "double"}
    assert sorted(r["a"] for r in df.collect()) == [float("-inf"), 1.0, 3.0, float("inf")]


def test_empty_file(spark, tmp_path):
    with pytest.raises(ValueError):
        csv.read_csv(spark, write(tmp_path, "none.csv", ""))


# ---- numbers


def test_fractions_among_whole_numbers(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "i int")
    filled = values.fill_value(df, "i", 0.5)
    assert filled.dtypes == [("i", "double")] and collected(filled) == [(0.5,), (1.0,), (2.0,)]
    replaced = values.find_replace(df, "i", 1, 1.5)
    assert replaced.dtypes == [("i", "double")] and collected(replaced) == [(1.5,), (2.0,), (None,)]
    assert values.find_replace(df, "i", float("inf"), 1).dtypes == df.dtypes
    assert values.find_replace(df, "i", float("nan"), 1).dtypes == df.dtypes
    assert values.find_replace(df, "i", 1, decimal.Decimal("2")).dtypes in ([("i", "int")], [("i", "double")])
    assert values.find_replace(df, "i", 1, "x").dtypes == [("i", "string")]
    assert collected(values.fill_value(df, "i", 7)) == [(1,), (2,), (7,)]


def test_text_of_single_precision(spark):
    df = spark.createDataFrame([(0.1,), (1e7,), (1e-5,), (None,)], "x float")
    assert collected(types.change_type(df, "x", "string")) == [("0.1",), ("10000000.0",), ("1e-05",), (None,)]


def test_whole_nanoseconds_in_odd_columns(spark):
    df = spark.createDataFrame([(-1,), (1_999,)], "`a``b.c` long")
    found = [str(r[0]) for r in types.change_type(df, "a`b.c", "datetime").collect()]
    assert found[1].endswith("00:00:00.000001")


# ---- patterns


@pytest.mark.parametrize(
    "pattern, replacement, text, expected",
    [
        (r"(?P<first_part>[a-z]+)_(?P<b>\d)", r"\g<b>-\g<first_part>", "ab_1", "1-ab"),
        (r"(?P<a_b>x)(?P=a_b)", "y", "xxx", "yx"),
        (r"a{,2}b", "-", "aaab", "a-"),
        (r"\{,2}", "-", "{,2}", "-"),
    ],
)
def test_python_patterns(spark, pattern, replacement, text, expected):
    df = spark.createDataFrame([(text,)], "s string")
    assert values.find_replace_regex(df, "s", pattern, replacement).first()[0] == expected


# ---- maps, paths, pages, categories


def test_empty_chain(spark):
    df = spark.createDataFrame([("a",)], "s string")
    none = spark.createDataFrame([], "old string, new string")
    assert collected(dedupe.replace_duplicates(df, "s", none, chain=True)) == [("a",)]


def test_replacing_beside_a_table_of_similar_name(spark):
    path = new_path(spark, "t")
    tables.write_table(spark.range(3), path)
    other = tables.write_table(spark.range(5), path + "2")
    assert tables.replace_table(other, path).count() == 5
    with pytest.raises(ValueError):
        tables.replace_table(spark.read.parquet(path + "2").where("id > 1"), path + "2/")


def test_envelopes_are_short(spark):
    df = spark.range(5)
    with pytest.raises(ValueError):
        rows.page_envelope(df, {"draw": 1, "length": 10_001})
    assert rows.page_envelope(df, {"draw": 1, "length": 2})["data"] == [[0], [1]]


def test_categories_beyond_a_thousand(spark):
    df = spark.range(1200).selectExpr("id", "concat('c', id) AS c")
    assert len(encode.one_hot_encode(df, "c").columns) == 1201
    assert encode.one_hot_encode(df, "c", categories=["c7", "zz"]).where("c_c7 = 1 AND c_zz = 0").count() == 1
    long = encode.one_hot_long(df, "c", ["id"])
    assert long.columns == ["id", "category"] and long.count() == 1200


# ---- order


def test_order_of_ordered_queries(spark):
    gaps = QUERIES["order_multi"](spark, SF).collect()
    key = [(r["o_orderpriority"] is not None, r["o_orderpriority"]) for r in gaps]
    nulls = [k for k in key if not k[0]]
    texts = [k[1] for k in key if k[0]]
    assert key == nulls + [(True, t) for t in texts] and texts == sorted(texts, reverse=True)
    names = [r[0] for r in QUERIES["categories"](spark, SF).collect()]
    assert names == sorted(names)
    page = QUERIES["page_envelope"](spark, SF).collect()
    assert [tuple(r)[3:] for r in page] == [tuple(r) for r in gaps[20:35]]
    log = [(r["data_id"], r["version"]) for r in QUERIES["versions_ordered"](spark, SF).collect()]
    assert log == sorted(log)


# ---- stored versions


def test_undo_and_drop_of_saved_versions(spark):
    folder = new_path(spark, "session")
    a, b = spark.range(3).toDF("x"), spark.range(2).toDF("y")
    s = versions.Session({"a": a, "b": b}, "start")
    s.save(folder)
    s.step(rows.delete_where, "x < 1", describe="one").save(folder)
    s.undo()
    s.step(rows.delete_where, "x < 2", describe="two").save(folder)
    loaded = versions.Session.load(spark, folder)
    assert loaded.history() == ["two", "start"] and collected(loaded.table("a")) == [(2,)]
    assert loaded.table("b").inputFiles() == loaded.undo().table("b").inputFiles()  # kept once
    assert versions.Session.load(spark, folder).history() == ["start"]
    loaded.step(rows.rename_columns, {"x": "z"}, describe="three").save(folder)
    loaded.drop(1)
    again = versions.Session.load(spark, folder)
    assert again.history() == ["three"] and again.table("a").columns == ["z"]
    with pytest.raises(ValueError):
        again.drop(again.version)


# ---- filters reach the scan


def pushed(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("PushedFilters: [") :].split("]")[0].removeprefix("PushedFilters: [")


@pytest.mark.parametrize("predicate", ["o_orderkey < 10", "10 > o_custkey", "o_orderpriority = '5-LOW'", "o_custkey < 5 OR o_orderkey > 9"])
def test_deleting_reaches_the_scan(spark, predicate):
    assert pushed(rows.delete_where(tables.scan(spark, f"{SF}/orders.parquet"), predicate))


def test_removing_outliers_reaches_the_scan(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    assert pushed(scale.remove_outliers(orders, "o_orderkey"))


def test_deleting_keeps_empty_cells(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (None, None, float("nan")), (5, "b", 9.0)], "i int, s string, x double")
    assert rows.delete_where(df, "i < 3").count() == 2
    assert rows.delete_where(df, "s = 'a' OR i > 4").count() == 1
    assert rows.delete_where(df, "s = 'a' AND i > 0").count() == 2
