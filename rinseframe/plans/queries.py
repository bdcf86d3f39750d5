"""Every operator as a query over the test tables.

Cells are made empty by a rule of the data: the price of an order still pending
("P") is taken as unknown, and the priority "4-NOT SPECIFIED" as not given.
"""

from __future__ import annotations

import functools
import io
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinseframe.operators import bins, dedupe, encode, joins, rows, scale, stats, types, values
from rinseframe.operators.rows import Cell
from rinseframe.plans import versions
from rinseframe.plans.lineage import new_path
from rinseframe.sources import csv, dump, tables, zip as zips
from rinseframe.streaming.rowwise import clean_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return tables.scan(spark, f"{sf}/{name}.parquet")


def orders_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("o_totalprice"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("o_custkey"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("o_orderpriority"),
        "o_orderdate",
    )


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# ---- sources and sinks


@query
def scan(spark, sf):
    return read(spark, sf, "orders")


@query
def scan_renamed(spark, sf):
    return rows.rename_columns(read(spark, sf, "supplier"), {"s_suppkey": "id", "s_acctbal": "balance"})


@query
def scan_csv(spark, sf):
    path = new_path(spark, "scan_csv")
    csv.write_csv(read(spark, sf, "customer"), path)
    return csv.read_csv(spark, path)


@query
def scan_csv_empty(spark, sf):
    """Empty cells written with a marker and read back as empty."""
    path = new_path(spark, "scan_csv_empty")
    csv.write_csv(orders_with_gaps(spark, sf), path, sep=";", empty="N/A")
    return csv.read_csv(spark, path, sep=";")


@query
def scan_csv_texts(spark, sf):
    """Whole texts with quotes, separators and line breaks."""
    path = new_path(spark, "scan_csv_texts")
    csv.write_csv(read(spark, sf, "documents"), path)
    return csv.read_csv(spark, path)


@query
def csv_round_trip(spark, sf):
    """Cells that begin and end in blanks, tabs and line breaks."""
    path = new_path(spark, "csv_round_trip")
    padded = {"text": F.concat(F.lit("  "), "text", F.lit(" \t")), "lang": F.concat(F.lit("\n "), "lang"), "source": F.concat("source", F.lit(" \n"))}
    csv.write_csv(read(spark, sf, "documents").withColumns(padded), path)
    return csv.read_csv(spark, path)


@query
def csv_count(spark, sf):
    """Rows of a CSV table of which no column is asked for."""
    path = new_path(spark, "csv_count")
    csv.write_csv(read(spark, sf, "customer"), path)
    return csv.read_csv(spark, path).agg(F.count("*").alias("n"))


@query
def csv_stray_quotes(spark, sf):
    """Quotes within cells: inch marks, text after a closing quote, and cells over two lines beside them."""
    path = new_path(spark, "csv_stray_quotes")
    quoted = F.concat(F.lit('"'), F.replace("p_name", F.lit('"'), F.lit('""')), F.lit('" of "5"'))
    broken = F.concat(F.lit('"'), "p_brand", F.lit(', 7""\n'), "p_type", F.lit('"'))
    cells = [F.col("p_partkey").cast("string"), F.concat(F.col("p_size").cast("string"), F.lit('"')), quoted, broken]
    read(spark, sf, "part").select(F.concat_ws(",", *cells).alias("value")).write.text(path)
    return csv.read_csv(spark, path, header=False, schema="p_partkey long, inches string, name string, place string")


@query
def write_csv(spark, sf):
    path = new_path(spark, "write_csv")
    csv.write_csv(read(spark, sf, "lineitem"), path, sep="|")
    return spark.read.text(path).where(~F.col("value").startswith("l_orderkey|")).select(F.col("value").alias("line"))


@query
def scan_zip(spark, sf):
    """Each batch of rows zipped as one archive with a CSV member."""

    def zipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            target = io.BytesIO()
            with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("part.csv", batch.to_csv(index=False))
            yield pd.DataFrame({"path": ["part.zip"], "content": [target.getvalue()]})

    archives = read(spark, sf, "part").mapInPandas(zipped, "path string, content binary")
    return zips.read_archives(archives)["part.csv"]


@query
def scan_zip_members(spark, sf):
    """Archives of five members each, in a shared folder; every member is read by a task of its own."""
    path = new_path(spark, "scan_zip_members")
    folder = path if "://" in path else f"file://{path}"

    def zipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root)
        for batch in batches:
            name = f"{uuid.uuid4().hex}.zip"
            with files.open_output_stream(f"{root}/{name}") as target, zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
                for i, rows in batch.groupby(batch["p_partkey"] % 5):
                    archive.writestr(f"part{i}.csv", rows.to_csv(index=False))
            yield pd.DataFrame({"name": [name]})

    read(spark, sf, "part").mapInPandas(zipped, "name string").count()
    members = zips.read_zip(spark, path)
    return functools.reduce(DataFrame.unionByName, members.values())


@query
def scan_sql_dump(spark, sf):
    """Whole texts through INSERT statements, with quotes, semicolons and line breaks."""
    path = new_path(spark, "scan_sql_dump")

    def quoted(name: str):
        return F.concat(F.lit("'"), F.replace(F.col(name), F.lit("'"), F.lit("''")), F.lit("'"))

    cells = F.concat_ws(", ", F.col("page_id").cast("string"), quoted("url"), quoted("html"))
    inserts = read(spark, sf, "pages").select(F.concat(F.lit("INSERT INTO pages VALUES ("), cells, F.lit(");")))
    created = "CREATE TABLE pages (page_id bigint, url varchar(200), html text, PRIMARY KEY (page_id));"
    spark.createDataFrame([(created,)], "s string").union(inserts).write.text(path)
    return dump.read_dump(spark, path)["pages"]


def commented_dump(spark: SparkSession, sf: str, path: str) -> None:
    """Two tables as a dump with apostrophes in every kind of comment and semicolons in texts."""

    def quoted(c):
        return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("\\'")), F.lit("'"))

    created = [
        "/* it's; a dump */ CREATE TABLE suppliers (s_suppkey bigint, -- supplier's id; unique",
        "  s_name text, # don't index",
        "  s_acctbal double precision);",
        'CREATE TABLE "parts" (p_partkey bigint, /* what\'s this */ p_name text);',
    ]
    comment = F.when(F.col("n") % 3 == 0, "/* it's; */ ").when(F.col("n") % 3 == 1, "# don't; \n").otherwise("-- isn't\n")
    suppliers = read(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("n"),
        F.concat(
            F.lit("INSERT INTO suppliers (s_name, s_suppkey, s_acctbal) VALUES ("),
            F.concat_ws(", ", quoted(F.concat("s_name", F.lit("; it's -- /* #"))), F.col("s_suppkey").cast("string"), F.col("s_acctbal").cast("string")),
            F.lit("); -- supplier's row"),
        ).alias("s"),
    )
    parts = read(spark, sf, "part").select(
        F.col("p_partkey").alias("n"),
        F.concat(F.lit('INSERT INTO "parts" VALUES ('), F.col("p_partkey").cast("string"), F.lit(" /* ; ' */, "), quoted(F.col("p_name")), F.lit(");")).alias("s"),
    )
    rows_ = suppliers.unionByName(parts).select(F.concat(comment, "s").alias("s"))
    spark.createDataFrame([("\n".join(created),)], "s string").unionByName(rows_).write.text(path)


@query
def scan_sql_dump_comments(spark, sf):
    path = new_path(spark, "scan_sql_dump_comments")
    commented_dump(spark, sf, path)
    found = dump.read_dump(spark, path)
    supplier = found["suppliers"].selectExpr("'supplier' AS kind", "s_suppkey AS id", "s_name AS name", "s_acctbal AS balance")
    return supplier.unionByName(found["parts"].selectExpr("'part' AS kind", "p_partkey AS id", "p_name AS name", "CAST(NULL AS double) AS balance"))


@query
def load_path_sql(spark, sf):
    """A dump found by its extension."""
    path = new_path(spark, "load") + ".sql"
    commented_dump(spark, sf, path)
    return tables.load_path(spark, path)["parts"]


@query
def load_path(spark, sf):
    path = new_path(spark, "load") + ".csv"
    csv.write_csv(read(spark, sf, "part"), path)
    return tables.load_path(spark, path)[csv.table_name(path)]


@query
def ctas(spark, sf):
    selected = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return tables.write_table(selected, new_path(spark, "ctas"))


@query
def copy_table(spark, sf):
    return tables.copy_table(spark, f"{sf}/part.parquet", new_path(spark, "copy"))[0]


@query
def replace_table(spark, sf):
    path = new_path(spark, "replace")
    tables.write_table(read(spark, sf, "supplier"), path)
    return tables.replace_table(read(spark, sf, "customer"), path)


# ---- projections


@query
def select_column(spark, sf):
    return rows.select_column(read(spark, sf, "lineitem"), "l_shipdate")


@query
def drop_column(spark, sf):
    return rows.drop_column(read(spark, sf, "orders"), "o_orderdate")


# ---- row deletion


@query
def delete_eq(spark, sf):
    return rows.delete_rows(orders_with_gaps(spark, sf), (Cell("o_orderpriority"), "=", "5-LOW"))


@query
def delete_lt_or(spark, sf):
    return rows.delete_rows(
        orders_with_gaps(spark, sf),
        (Cell("o_totalprice"), "<", 100000),
        (Cell("o_totalprice"), ">", 400000.5),
        connective="OR",
    )


@query
def delete_contains_and_not(spark, sf):
    return rows.delete_where(
        orders_with_gaps(spark, sf), "o_orderpriority CONTAINS 'IUM' AND NOT o_totalprice > 250000"
    )


@query
def delete_columns_compared(spark, sf):
    return rows.delete_where(read(spark, sf, "lineitem"), "l_discount > l_tax OR l_returnflag = l_linestatus")


# ---- find and replace, filling


@query
def find_replace(spark, sf):
    return values.find_replace(read(spark, sf, "orders"), "o_orderpriority", "5-LOW", "LOW")


@query
def find_replace_number(spark, sf):
    return values.find_replace(read(spark, sf, "lineitem"), "l_quantity", {1: 2, 2: 1, 50.0: 0})


@query
def find_replace_regex(spark, sf):
    return values.find_replace_regex(read(spark, sf, "customer"), "c_name", r"Customer#0*([0-9]+)", r"C<\1>")


@query
def find_replace_regex_texts(spark, sf):
    return values.find_replace_regex(read(spark, sf, "documents"), "text", r"[0-9]+([.,][0-9]+)?", "#")


@query
def find_replace_regex_named(spark, sf):
    """Named groups and an open repeat count in Python's spelling."""
    pattern = r"(?P<first_part>[A-Z][a-z]+)#0{,9}(?P<second_part>[0-9]*)"
    return values.find_replace_regex(read(spark, sf, "customer"), "c_name", pattern, r"\g<second_part> \g<first_part>")


@query
def find_replace_fraction(spark, sf):
    """Fractions among whole numbers."""
    return values.find_replace(read(spark, sf, "part"), "p_size", {1: 1.5, 2: 2.25, 50: 0})


@query
def fill_value_fraction(spark, sf):
    return values.fill_value(orders_with_gaps(spark, sf), "o_custkey", 0.5)


@query
def find_replace_all(spark, sf):
    return values.find_replace_all(read(spark, sf, "lineitem"), ["F", "O"], ["final", "open"])


@query
def fill_mean(spark, sf):
    return rounded(values.fill_mean(orders_with_gaps(spark, sf), "o_totalprice"), "o_totalprice")


@query
def fill_median(spark, sf):
    return values.fill_empty(orders_with_gaps(spark, sf), "o_totalprice", "median")


@query
def fill_value(spark, sf):
    filled = values.fill_value(orders_with_gaps(spark, sf), "o_totalprice", 0)
    return values.fill_value(filled, "o_orderpriority", "none")


@query
def fill_value_text(spark, sf):
    """A text in a column of numbers turns the column into text."""
    return values.fill_value(orders_with_gaps(spark, sf), "o_custkey", "unknown")


@query
def fill_all_mean(spark, sf):
    return rounded(values.fill_all_mean(orders_with_gaps(spark, sf)), "o_totalprice", "o_custkey")


@query
def fill_all_median(spark, sf):
    return values.fill_all_median(orders_with_gaps(spark, sf))


# ---- scaling, outliers


@query
def normalize(spark, sf):
    return scale.normalize(read(spark, sf, "lineitem"), "l_extendedprice")


@query
def normalize_all(spark, sf):
    return scale.normalize_all(read(spark, sf, "part"))


@query
def remove_outliers(spark, sf):
    return scale.remove_outliers(read(spark, sf, "orders"), "o_totalprice", 1.5)


@query
def remove_outliers_with_gaps(spark, sf):
    return scale.remove_outliers(orders_with_gaps(spark, sf), "o_totalprice", 1.2)


@query
def remove_all_outliers(spark, sf):
    return scale.remove_all_outliers(read(spark, sf, "lineitem"), 1.6)


# ---- bins, one-hot


@query
def bin_equiwidth(spark, sf):
    return bins.bin_equiwidth(read(spark, sf, "orders"), "o_totalprice", 4, id_column="bin")


@query
def bin_equifreq(spark, sf):
    return bins.bin_equifreq(read(spark, sf, "orders"), "o_totalprice", 5, id_column="bin")


@query
def bin_ranges(spark, sf):
    return bins.bin_ranges(read(spark, sf, "lineitem"), "l_quantity", [40, 10, 25.5], id_column="bin")


@query
def one_hot_prefixed(spark, sf):
    return encode.one_hot_encode(read(spark, sf, "orders"), "o_orderstatus", use_old_name=True)


@query
def one_hot_plain(spark, sf):
    return encode.one_hot_encode(orders_with_gaps(spark, sf), "o_orderpriority", use_old_name=False)


# ---- types, dates


@query
def to_string(spark, sf):
    return types.change_type(read(spark, sf, "lineitem"), "l_extendedprice", "string")


@query
def to_int(spark, sf):
    return types.change_type(read(spark, sf, "lineitem"), "l_extendedprice", "int")


@query
def to_float(spark, sf):
    text = types.change_type(orders_with_gaps(spark, sf), "o_totalprice", "string")
    return types.change_type(text, "o_totalprice", "float")


@query
def to_datetime(spark, sf):
    text = read(spark, sf, "events").withColumn("ts", F.date_format("ts", "M/d/yyyy H:mm:ss"))
    return types.change_type(text, "ts", "datetime")


@query
def to_datetime_from_number(spark, sf):
    """Nanoseconds since the epoch."""
    nanos = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return types.change_type(read(spark, sf, "events").withColumn("ts", nanos), "ts", "datetime")


def _extract(part: str) -> Query:
    return lambda spark, sf: types.extract_from_datetime(read(spark, sf, "events"), "ts", part)


for _part in types.DATE_PARTS:
    QUERIES[f"extract_{_part}"] = _extract(_part)


# ---- aggregates


@query
def column_stats(spark, sf):
    return rounded(stats.column_stats(read(spark, sf, "lineitem")), "mean", "std")


@query
def quantiles(spark, sf):
    names = ["l_extendedprice", "l_quantity", "l_partkey"]
    found = stats.quantile_table(read(spark, sf, "lineitem"), names, [0.0, 0.1, 0.5, 0.75, 1.0])
    return rounded(found, "value")


@query
def row_count(spark, sf):
    return stats.row_count(read(spark, sf, "lineitem"))


@query
def categories(spark, sf):
    return stats.categories(orders_with_gaps(spark, sf), "o_orderpriority")


@query
def value_counts(spark, sf):
    return stats.value_counts(read(spark, sf, "part"), "p_name")


@query
def profile_histogram(spark, sf):
    return bins.profile_histogram(read(spark, sf, "orders"))


# ---- joins


@query
def join_full(spark, sf):
    two = {"customer": read(spark, sf, "customer"), "orders": read(spark, sf, "orders")}
    return joins.join_tables(two, ["c_custkey", "o_custkey"])


@query
def join_full_gaps(spark, sf):
    """Empty keys on one side match nothing and stay."""
    two = {"o": orders_with_gaps(spark, sf), "c": read(spark, sf, "customer")}
    return joins.join_tables(two, ["o_custkey", "c_custkey"])


@query
def join_full_multikey(spark, sf):
    two = {"o": read(spark, sf, "orders"), "l": read(spark, sf, "lineitem")}
    return joins.join_tables(two, ["o_orderkey", "l_orderkey"], ["o_orderstatus", "l_linestatus"])


@query
def join_hot_key(spark, sf):
    """A key with a quarter of the left rows, another with two fifths of the right rows, found by the join itself."""
    key = F.when(F.col("l_linenumber") == 1, F.lit(0)).otherwise(F.col("l_orderkey"))
    lines = read(spark, sf, "lineitem").select(key.alias("k"), "l_linenumber", "l_quantity")
    key = F.when(F.col("o_orderkey") <= 40, F.lit(0)).when(F.col("o_orderpriority") < "3", F.lit(-1)).otherwise(F.col("o_orderkey"))
    orders = read(spark, sf, "orders").select(key.alias("k"), "o_orderkey")
    joined = joins.join_tables({"l": lines, "o": orders}, ["k", "k"], hot_rows=100)
    keys = [F.col(f"`{c}`").alias(c.replace(".", "_")) for c in ("l.k", "o.k", "o.o_orderkey")]
    return joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("`l.l_quantity`").alias("quantity"))


@query
def join_chain(spark, sf):
    three = {
        "region": read(spark, sf, "region"),
        "nation": read(spark, sf, "nation"),
        "customer": read(spark, sf, "customer"),
    }
    # of the whole tables, nations pair with regions and then customers with nations
    return joins.join_tables(three, ["r_regionkey", "n_regionkey", None], [None, "n_nationkey", "c_nationkey"])


@query
def join_chain_same_key(spark, sf):
    """One match over all tables: each is matched with its neighbour only."""
    three = {
        "p": read(spark, sf, "part"),
        "s": read(spark, sf, "supplier"),
        "c": read(spark, sf, "customer"),
    }
    return joins.join_tables(three, ["p_partkey", "s_suppkey", "c_custkey"])


@query
def join_chain_partial(spark, sf):
    """No match between the last two tables: joined unconditionally."""
    three = {
        "region": read(spark, sf, "region"),
        "nation": read(spark, sf, "nation"),
        "supplier": read(spark, sf, "supplier"),
    }
    return joins.join_tables(three, ["r_regionkey", "n_regionkey", None], cross=True)


@query
def join_unconditional(spark, sf):
    return joins.join_tables({"supplier": read(spark, sf, "supplier"), "region": read(spark, sf, "region")}, cross=True)


@query
def join_named(spark, sf):
    """Two tables of a session replaced by their join."""
    session = versions.Session(
        {"supplier": read(spark, sf, "supplier"), "nation": read(spark, sf, "nation")}, "INIT"
    ).join("supplier", "nation", ["s_nationkey"], ["n_nationkey"], "located")
    return session.table("located")


@query
def semi_join_exists(spark, sf):
    """Customers (users) for whom an urgent order (role) exists."""
    return joins.holders(
        read(spark, sf, "customer"), read(spark, sf, "orders"), ("c_custkey", "o_custkey"), "o_orderpriority", "1-URGENT"
    )


@query
def semi_join_in(spark, sf):
    """Lines (datasets) with their order (role) where that is among the events' users' (held) keys."""
    return joins.accessible(
        read(spark, sf, "lineitem"),
        read(spark, sf, "orders"),
        read(spark, sf, "events"),
        ("l_orderkey", "o_orderkey"),
        "user_id",
    )


# ---- near-duplicates


@query
def similar_pairs(spark, sf):
    return dedupe.similar_pairs(read(spark, sf, "part"), "p_name", 3, order_col="p_partkey")


@query
def similar_pairs_names(spark, sf):
    return dedupe.similar_pairs(read(spark, sf, "customer"), "c_name", 1, order_col="c_custkey")


@query
def similar_pairs_urls(spark, sf):
    return dedupe.similar_pairs(read(spark, sf, "pages"), "url", 2, order_col="page_id")


@query
def similar_pairs_texts(spark, sf):
    """Whole documents; checked against brute force on a small fixture only."""
    return dedupe.similar_pairs(read(spark, sf, "documents"), "text", 8, order_col="doc_id")


@query
def dedupe_candidates(spark, sf):
    return dedupe.find_duplicates(read(spark, sf, "part"), "p_name", 3, order_col="p_partkey")


@query
def dedupe_candidates_names(spark, sf):
    return dedupe.find_duplicates(read(spark, sf, "customer"), "c_name", 1)


@query
def dedupe_lists(spark, sf):
    lists = dedupe.candidate_lists(dedupe.find_duplicates(read(spark, sf, "part"), "p_name", 3, order_col="p_partkey"))
    return lists.select("value", F.array_join("candidates", "|").alias("candidates"))


# a chain, a self-map, a two-step cycle and a plain replacement
NAME_MAP = {
    "red bolt": "blue bolt",
    "blue bolt": "small bolt",
    "hot gear": "hot gear",
    "small ring": "red ring",
    "red ring": "small ring",
    "red widget": "widget",
}


@query
def replace_map(spark, sf):
    return dedupe.replace_duplicates(read(spark, sf, "part"), "p_name", NAME_MAP)


@query
def replace_map_chain(spark, sf):
    return dedupe.replace_duplicates(read(spark, sf, "part"), "p_name", NAME_MAP, chain=True)


@query
def replace_map_table(spark, sf):
    """Every near-duplicate replaced by its best candidate."""
    part = read(spark, sf, "part")
    best = dedupe.find_duplicates(part, "p_name", 3, order_col="p_partkey").where("rank = 1")
    mapping = best.select(F.col("value").alias("old"), F.col("candidate").alias("new"))
    return dedupe.replace_duplicates(part, "p_name", mapping)


@query
def replace_map_table_chain(spark, sf):
    """Customers stand for the one with half their number, and so on to the first."""
    customer = read(spark, sf, "customer")
    parent = customer.select((F.col("c_custkey") * 2).alias("_twice"), F.col("c_name").alias("new"))
    child = customer.select((F.col("c_custkey") - F.col("c_custkey") % 2).alias("_twice"), F.col("c_name").alias("old"))
    mapping = child.join(parent, "_twice").where("old <> new").select("old", "new")
    return dedupe.replace_duplicates(customer, "c_name", mapping, chain=True)


# ---- order and pages


ORDER = [{"column": 4, "dir": "desc"}, {"column": 2, "dir": "ASC"}, {"column": 0, "dir": "asc"}, {"column": "x"}]


@query
def order_multi(spark, sf):
    return rows.order_multi(orders_with_gaps(spark, sf), ORDER)


@query
def page(spark, sf):
    return rows.page(orders_with_gaps(spark, sf), 20, 10, ORDER)


@query
def page_last(spark, sf):
    lines = read(spark, sf, "lineitem")
    return rows.page(lines, lines.count() - 5, 10, [{"column": 5, "dir": "asc"}])


# ---- versions


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as a version log: turns are versions, their texts the descriptions."""
    return read(spark, sf, "conversations").select(
        F.col("conv_id").alias("data_id"), F.col("turn").alias("version"), F.col("text").alias("description")
    )


@query
def latest_version(spark, sf):
    return versions.latest_version(_log(spark, sf))


@query
def next_version(spark, sf):
    datasets = read(spark, sf, "documents").select(F.col("doc_id").alias("data_id"))
    return versions.next_version(_log(spark, sf), datasets)


@query
def history(spark, sf):
    return versions.history(_log(spark, sf))


@query
def undo(spark, sf):
    return versions.undo(_log(spark, sf))


@query
def versions_ordered(spark, sf):
    return versions.in_order(_log(spark, sf))


@query
def drop_snapshot(spark, sf):
    log = _log(spark, sf)
    return versions.drop_snapshot(log, versions.latest_version(log))


def cleaned_orders(spark: SparkSession, sf: str) -> versions.Session:
    """Join, outliers, normalise, bin, weekday and one-hot, one version each."""
    session = versions.Session(
        {"orders": read(spark, sf, "orders"), "customer": read(spark, sf, "customer")}, "INIT FROM PARQUET"
    )
    # every fitted step below reads the joined table again
    session.join("orders", "customer", ["o_custkey"], ["c_custkey"], "sales").settle()
    price, balance = "orders.o_totalprice", "customer.c_acctbal"
    return (
        session.step(scale.remove_outliers, price, 1.5, describe=f"REMOVE OUTLIERS WITH RANGE 1.5 IN {price}")
        .step(scale.normalize, price, describe=f"NORMALIZE {price}")
        .step(bins.bin_equifreq, balance, 4, describe=f"DISCRETIZE (EQUIFREQ) TO 4 BINS IN {balance}")
        .step(types.extract_from_datetime, "orders.o_orderdate", "weekday", describe="EXTRACT weekday")
        .step(encode.one_hot_encode, "orders.o_orderstatus", True, describe="ONE-HOT ENCODE orders.o_orderstatus")
    )


@query
def cleaning_pipeline(spark, sf):
    return cleaned_orders(spark, sf).table("sales")


@query
def pipeline_undone(spark, sf):
    return cleaned_orders(spark, sf).undo().undo().undo().table("sales")


@query
def pipeline_saved(spark, sf):
    """A version written as a snapshot and loaded again."""
    folder = new_path(spark, "session")
    session = versions.Session({"orders": read(spark, sf, "orders")}, "INIT FROM PARQUET")
    session.save(folder)
    session.step(rows.drop_column, "o_orderdate", describe="DELETE COLUMN o_orderdate").save(folder)
    return versions.Session.load(spark, folder).table("orders")


@query
def session_undone(spark, sf):
    """Undo after saving, then another step, saved and loaded again."""
    folder = new_path(spark, "session")
    session = versions.Session({"orders": read(spark, sf, "orders"), "customer": read(spark, sf, "customer")}, "INIT FROM PARQUET")
    session.save(folder)
    session.step(rows.drop_column, "o_orderdate", describe="DELETE COLUMN o_orderdate").save(folder)
    session.undo()
    session.step(rows.drop_column, "o_orderstatus", describe="DELETE COLUMN o_orderstatus").save(folder)
    return versions.Session.load(spark, folder).table("orders")


# ---- paging envelope, streams


@query
def page_envelope(spark, sf):
    request = {"draw": "7", "start": 20, "length": 15, "order": [{"column": 4, "dir": "desc"}, {"column": 2, "dir": "asc"}, {"column": 0, "dir": "asc"}]}
    return rows.page_table(orders_with_gaps(spark, sf), request)


@query
def stream_events(spark, sf):
    """Row-level steps on arriving files, all files that are there taken once."""
    source, target, checkpoint = (new_path(spark, f"stream_{n}") for n in ("source", "target", "checkpoint"))
    events = read(spark, sf, "events")
    events.write.parquet(source)
    steps = [
        lambda df: values.find_replace(df, "event_type", "click", "CLICK"),
        lambda df: rows.delete_rows(df, (Cell("user_id"), "<", 10)),
        lambda df: types.extract_from_datetime(df, "ts", "weekday"),
    ]
    clean_stream(spark, source, events.schema, steps, target, checkpoint).awaitTermination()
    return spark.read.parquet(target)


@query
def one_hot_sparse(spark, sf):
    """Two columns, one with a category for nearly every row, as sparse vectors."""
    found = encode.one_hot_sparse(read(spark, sf, "part").select("p_partkey", "p_brand", "p_name"), ["p_brand", "p_name"])
    indices = F.array_join(F.col("one_hot.indices").cast("array<string>"), ",").alias("indices")
    return found.select("p_partkey", F.col("one_hot.size").alias("size"), indices)


@query
def snapshots_left(spark, sf):
    """Rows of the stored tables that are left when two of three saved versions are gone."""
    folder = new_path(spark, "snapshots_left")
    named = {n: read(spark, sf, n) for n in ("orders", "customer")}
    session = versions.Session(named, "INIT")
    session.save(folder)
    session.step(rows.delete_rows, (Cell("o_totalprice"), "<", 100_000), table="orders", describe="DELETE ROWS").save(folder)
    session.step(rows.drop_column, "c_acctbal", table="customer", describe="DROP COLUMN").save(folder)
    session.undo().drop(1)
    versions.collect_snapshots(spark, folder, 0)
    left = [spark.read.parquet(path) for path in versions.stored_tables(spark, folder)]
    counts = [t.agg(F.lit(t.columns[0]).alias("first_column"), F.count(F.lit(1)).alias("n")) for t in left]
    return functools.reduce(DataFrame.unionByName, counts)
