"""Full outer joins: empty keys, hot keys, chains, unconditional joins."""

from math import sqrt

import pytest
from pyspark.sql import functions as F

from rinseframe.operators import joins


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def native(left, right, condition):
    return left.join(right, condition, "full")


def test_empty_keys_and_unmatched(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    b = spark.createDataFrame([(1, 10), (3, 30), (None, 0)], "k int, w int")
    joined = joins.join_tables({"a": a, "b": b}, ["k", "k"])
    assert joined.columns == ["a.k", "a.v", "b.k", "b.w"]
    assert rows(joined) == sorted(
        [
            (1, "x", 1, 10),
            (2, "y", None, None),
            (None, "z", None, None),
            (None, None, 3, 30),
            (None, None, None, 0),
        ],
        key=repr,
    )


def test_hot_and_repeated_keys(spark):
    # a third of the rows of both sides has one key, a third of the left has none
    a = spark.createDataFrame([((7, None, i)[i % 3], i) for i in range(90)], "k int, i int")
    b = spark.createDataFrame([((7, i, i + 1)[i % 3], i) for i in range(60)], "k int, j int")
    a2, b2 = a.toDF("a.k", "a.i"), b.toDF("b.k", "b.j")
    expected = native(a2, b2, a2["`a.k`"] == b2["`b.k`"])
    assert rows(joins.join_tables({"a": a, "b": b}, ["k", "k"])) == rows(expected)


def test_two_key_pairs(spark):
    a = spark.createDataFrame([(1, "p"), (1, "q"), (2, None)], "k int, s string")
    b = spark.createDataFrame([(1, "p"), (2, "q"), (2, None)], "k int, s string")
    joined = rows(joins.join_tables({"a": a, "b": b}, ["k", "k"], ["s", "s"]))
    assert len(joined) == 5 and (1, "p", 1, "p") in joined


def test_chain_matches_neighbours_only(spark):
    a = spark.createDataFrame([(1,), (2,)], "x int")
    b = spark.createDataFrame([(2,), (3,)], "x int")
    c = spark.createDataFrame([(1,), (3,)], "x int")
    joined = joins.join_tables({"a": a, "b": b, "c": c}, ["x", "x", "x"])
    # 1 is in a and c, but b lies between them
    assert rows(joined) == sorted(
        [(1, None, None), (2, 2, None), (None, 3, 3), (None, None, 1)], key=repr
    )


def test_chain_of_four_equals_native(spark):
    tables = {n: spark.createDataFrame([((i * s) % 7, i) for i in range(9)], "k int, v int") for n, s in zip("abcd", (1, 2, 3, 5))}
    joined = joins.join_tables(tables, ["k", "k", "k", None], [None, None, "v", "v"])
    t = {n: df.toDF(f"{n}.k", f"{n}.v") for n, df in tables.items()}
    expected = native(t["a"], t["b"], t["a"]["`a.k`"] == t["b"]["`b.k`"])
    expected = native(expected, t["c"], t["b"]["`b.k`"] == t["c"]["`c.k`"])
    expected = native(expected, t["d"], t["c"]["`c.v`"] == t["d"]["`d.v`"])
    assert rows(joined) == rows(expected)


@pytest.mark.parametrize("broadcast_bytes", [10_000, 0])
def test_unconditional(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", broadcast_bytes)
    monkeypatch.setattr(joins, "CELL_PAIRS", 4)
    a = spark.createDataFrame([(i,) for i in range(5)], "x int")
    b = spark.createDataFrame([(i,) for i in range(3)], "y int")
    assert rows(joins.join_tables({"a": a, "b": b}, cross=True)) == sorted(((i, j) for i in range(5) for j in range(3)), key=repr)
    assert rows(joins.join_tables({"a": a, "b": b.limit(0)}, cross=True)) == [(i, None) for i in range(5)]
    assert rows(joins.join_tables({"a": a.limit(0), "b": b}, cross=True)) == [(None, i) for i in range(3)]


def test_bad_matches(spark):
    a = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError):
        joins.join_tables({"a": a, "b": a}, ["x"])
    with pytest.raises(ValueError):
        joins.join_tables({"a": a, "b": a}, ["x", "nope"])
    with pytest.raises(ValueError):
        joins.join_two({"a": a, "b": a}, "a", "b", ["x"], [], "j")


def test_join_two_replaces_its_sources(spark):
    a = spark.createDataFrame([(1,)], "x int")
    tables = joins.join_two({"a": a, "b": a, "c": a}, "a", "b", ["x"], ["x"], "j")
    assert list(tables) == ["c", "j"]
    assert tables["j"].columns == ["a.x", "b.x"]


def test_one_full_outer_join_and_no_empty_keys_in_it(spark):
    sf = "/root/testdata/sf0.001"
    orders, lineitem = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("orders", "lineitem"))
    plan = joins.join_tables(
        {"o": orders, "l": lineitem}, ["o_orderkey", "l_orderkey"], ["o_orderstatus", "l_linestatus"]
    )._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FullOuter") == 1 and plan.count("FileScan") <= 4
    assert "isnotnull(o_orderkey" in plan and "isnotnull(l_orderkey" in plan


def test_pairs_of_all_rows_must_be_asked_for(spark):
    a = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError, match="cross=True"):
        joins.join_tables({"a": a, "b": a}, [None, "x"])


def test_hot_keys_are_joined_apart(spark):
    a = spark.createDataFrame([(None if i % 7 == 0 else i % 3, i) for i in range(60)], "k int, i int")
    b = spark.createDataFrame([(k, k * 10) for k in (0, 0, 1, 5)] + [(None, 1)], "k2 int, j int")
    hot = joins.hot_keys(a, ["k"], 15)
    assert 0 < hot.count() < 3 + 1
    expected = rows(joins.full_join(a, b, [("k", "k2")]))
    assert rows(joins.full_join(a, b, [("k", "k2")], hot)) == expected == rows(a.join(b, a["k"] == b["k2"], "full"))
    only_right = joins.hot_keys(b, ["k2"], 2)
    assert rows(joins.full_join(a, b, [("k", "k2")], only_right)) == expected


def test_full_join_reads_each_side_twice(spark):
    sf = "/root/testdata/sf0.001"
    o, c = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("orders", "customer"))
    plan = joins.full_join(o, c, [("o_custkey", "c_custkey")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 4


# ---- hot keys found by sketches, and the grid


@pytest.fixture
def whole_partitions(spark):
    """Shuffle partitions as they are, so that rows of each can be counted."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def third(spark, rows, name, seed):
    """A table in which one key has a third of all rows, and some keys are missing."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(rows)))
    return spark.range(rows).select(key.alias("k"), F.lit(1).alias(name))


def test_hot_key_is_split_without_being_named(spark, whole_partitions):
    a, b = third(spark, 3000, "x", 1), third(spark, 1500, "y", 2)
    joined = joins.join_tables({"a": a, "b": b}, ["k", "k"], hot_rows=100)
    tasks = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect() if r["count"] > 2000]
    assert len(tasks) >= 7 and max(tasks) <= 3 * sorted(tasks)[len(tasks) // 2]
    plain = a.toDF("a.k", "a.x").join(b.toDF("b.k", "b.y"), F.col("`a.k`") == F.col("`b.k`"), "full")
    both = [d.groupBy(*[f"`{c}`" for c in d.columns]).count() for d in (joined, plain)]
    assert rows(both[0]) == rows(both[1])


@pytest.mark.parametrize("kinds", [("int", "bigint"), ("double", "double"), ("string", "string"), ("int", "string")])
def test_split_keys_equal_native(spark, kinds):
    a = spark.createDataFrame([((0, 1, 2, i, None)[i % 5], i) for i in range(400)], "k int, i int").withColumn("k", F.col("k").cast(kinds[0]))
    b = spark.createDataFrame([((0, 2, i, 900 + i)[i % 4], i) for i in range(200)], "k int, j int").withColumn("k", F.col("k").cast(kinds[1]))
    if kinds[0] == "double":
        a = a.withColumn("k", F.when(F.col("k") == 0, F.lit(-0.0)).when(F.col("k") == 2, F.lit(float("nan"))).otherwise(F.col("k")))
        b = b.withColumn("k", F.when(F.col("k") == 2, F.lit(float("nan"))).otherwise(F.col("k")))
    a2, b2 = a.toDF("a.k", "a.i"), b.toDF("b.k", "b.j")
    expected = native(a2, b2, a2["`a.k`"] == b2["`b.k`"])
    assert bool(joins.hot_cells(a2, b2, [("a.k", "b.k")], 10)) == (kinds != ("int", "string"))
    assert repr(rows(joins.join_tables({"a": a, "b": b}, ["k", "k"], hot_rows=10))) == repr(rows(expected))
    only_left = joins.join_tables({"a": a, "b": b.where("j < 0")}, ["k", "k"], hot_rows=10)
    assert only_left.count() == 400


def test_chain_with_hot_keys(spark):
    a = spark.createDataFrame([(i % 3, i) for i in range(90)], "x int, i int")
    b = spark.createDataFrame([(0, i % 2) for i in range(40)], "x int, y int")
    c = spark.createDataFrame([(1, i) for i in range(30)], "y int, j int")
    args = ({"a": a, "b": b, "c": c}, ["x", "x", None], [None, "y", "y"])
    assert rows(joins.join_tables(*args, hot_rows=5)) == rows(joins.join_tables(*args))


def test_grid_copies_grow_with_the_root_of_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    for n, m, cells in [(10, 10, 4), (1000, 10, 64), (10**6, 10**6, 1024), (3, 10**9, 100), (1, 5, 8)]:
        r, c = joins.grid_sides(n, m, cells)
        assert 1 <= r <= n and 1 <= c <= m and (r * c >= cells or (r == n) or (c == m))
        assert n * c + m * r <= 2.5 * sqrt(cells * n * m) + n + m
    a, b = spark.range(300).toDF("x"), spark.createDataFrame([(5,)] * 200, "y int")
    joined = joins.full_join_unconditional(a, b)
    exchanged = joined.groupBy("x", "y").count()
    assert sorted(r["count"] for r in exchanged.collect()) == [200] * 300
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and plan.count("Generate explode") == 2
