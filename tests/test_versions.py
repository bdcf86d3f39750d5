"""Sessions, snapshots, logs and streaming."""

import datetime

import pytest

from rinseframe.operators import bins, rows, scale, values
from rinseframe.operators.stats import fit
from rinseframe.plans import versions
from rinseframe.plans.lineage import new_path, shared_folder
from rinseframe.streaming.rowwise import clean_stream


def session(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 3.0)], "k int, x double")
    b = spark.createDataFrame([(1, "u")], "k int, s string")
    return versions.Session({"a": a, "b": b}, "INIT FROM CSV a")


def test_steps_history_and_undo(spark):
    s = session(spark)
    s.step(scale.normalize, "x", describe="NORMALIZE x").join("a", "b", ["k"], ["k"], "j").rename("j", "joined")
    assert s.version == 4
    assert list(s.tables) == ["joined"]
    assert s.history(3) == ["RENAME j TO joined", "JOIN TABLES a AND b ON k=k", "NORMALIZE x"]
    s.undo().undo()
    assert list(s.tables) == ["a", "b"]
    assert [r["x"] for r in s.table("a").orderBy("k").collect()] == [0.0, 1.0]
    for _ in range(5):
        s.undo()
    assert s.version == 1 and s.history() == ["INIT FROM CSV a"]


def test_history_is_five_long(spark):
    s = session(spark)
    for i in range(7):
        s.step(lambda df: df, describe=str(i))
    assert s.history() == ["6", "5", "4", "3", "2"]


def test_settle_computes_once(spark):
    s = session(spark).settle()
    assert s.table().inputFiles()
    assert s.table().count() == 2


def test_save_and_load(spark):
    folder = new_path(spark, "session")
    s = session(spark)
    s.save(folder)
    s.step(values.find_replace, "k", 1, 5, describe="FIND 1 REPLACE 5 IN k").save(folder)
    loaded = versions.Session.load(spark, folder)
    assert loaded.version == 2 and loaded.history()[0] == "FIND 1 REPLACE 5 IN k"
    assert sorted(r["k"] for r in loaded.table("a").collect()) == [2, 5]
    assert sorted(r["k"] for r in loaded.undo().table("a").collect()) == [1, 2]
    with pytest.raises(Exception):
        s.save(folder)


def log(spark):
    entries = [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")] + [(3, i, str(i)) for i in range(1, 9)]
    return spark.createDataFrame(entries, "data_id int, version int, description string")


def test_log_operations(spark):
    table = log(spark)
    assert sorted(map(tuple, versions.latest_version(table).collect())) == [(1, 2), (2, 1), (3, 8)]
    datasets = spark.createDataFrame([(1,), (9,)], "data_id int")
    assert sorted(map(tuple, versions.next_version(table, datasets).collect())) == [(1, 3), (9, 1)]
    newest = versions.history(table).where("data_id = 3").orderBy("position").collect()
    assert [r["description"] for r in newest] == ["8", "7", "6", "5", "4"]
    undone = sorted(tuple(r)[:2] for r in versions.undo(table).where("data_id < 3").collect())
    assert undone == [(1, 1), (2, 1)]
    dropped = spark.createDataFrame([(3, 4), (3, 4)], "data_id int, version int")
    assert versions.drop_snapshot(table, dropped).count() == 10


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_stream_of_row_level_and_fitted_steps(spark):
    source, target, checkpoint = (new_path(spark, n) for n in ("source", "target", "checkpoint"))
    day = datetime.datetime(2020, 1, 1)
    frame = spark.createDataFrame([(i, float(i), "a", day) for i in range(10)], "i int, x double, s string, d timestamp_ntz")
    frame.write.parquet(source)
    bounds = fit(frame, ["x"], ["min", "max"])
    steps = [
        lambda df: values.find_replace(df, "s", "a", "b"),
        lambda df: rows.delete_where(df, "i < 5"),
        lambda df: bins.apply_bins(df, "i", [0.0, 6.0, 9.0]),
        lambda df: scale.apply_normalize(df, bounds),
    ]

    def run():
        clean_stream(spark, source, frame.schema, steps, target, checkpoint).awaitTermination()
        return spark.read.parquet(target).orderBy("x").collect()

    assert [tuple(r)[:3] for r in run()] == [
        ("(0.0, 6.0]" if i < 7 else "(6.0, 9.0]", i / 9, "b") for i in range(5, 10)
    ]
    frame.where("i = 9").write.mode("append").parquet(source)
    assert len(run()) == 6


# ---- collection of stored tables


def test_collection_keeps_what_versions_need(spark, tmp_path):
    folder = str(tmp_path / "saved")
    a, b = spark.range(10).toDF("x"), spark.range(5).toDF("y")
    session = versions.Session({"a": a, "b": b}, "INIT")
    session.save(folder)
    session.step(lambda df: df.where("x > 3"), describe="DELETE", table="a").save(folder)
    session.step(lambda df: df.where("y > 3"), describe="DELETE", table="b").save(folder)
    before = versions.stored_tables(spark, folder)
    assert len(before) == 4 and versions.collect_snapshots(spark, folder, 0) == []
    session.undo()
    assert versions.collect_snapshots(spark, folder, 3600) == []  # let go just now
    session.drop(1)
    gone = versions.collect_snapshots(spark, folder, 0)
    left = versions.stored_tables(spark, folder)
    assert len(gone) == 2 and set(left) == set(before) - set(gone)
    again = versions.Session.load(spark, folder)
    assert (again.table("a").count(), again.table("b").count(), again.version) == (6, 5, 2)
    assert versions.collect_snapshots(spark, folder, 0) == []


def test_collection_beside_a_save(spark, tmp_path):
    """Tables without a log row yet are as young as the save that writes them."""
    folder = str(tmp_path / "saved")
    session = versions.Session({"a": spark.range(3).toDF("x")}, "INIT")
    session.save(folder)
    spark.range(4).write.parquet(f"{folder}/tables/unfinished/0")
    assert versions.collect_snapshots(spark, folder, 600) == []
    assert [p.split("/")[-2] for p in versions.collect_snapshots(spark, folder, 0)] == ["unfinished"]


def test_save_after_collection_of_its_table_is_an_error(spark, tmp_path):
    folder = str(tmp_path / "saved")
    session = versions.Session({"a": spark.range(3).toDF("x"), "b": spark.range(3).toDF("y")}, "INIT")
    session.save(folder)
    session.step(lambda df: df.where("x > 1"), describe="DELETE", table="a").save(folder)
    session.step(lambda df: df.where("y > 1"), describe="DELETE", table="b")
    other = versions.Session.load(spark, folder)
    other.drop(2)
    assert len(versions.collect_snapshots(spark, folder, 0)) == 1
    with pytest.raises(FileNotFoundError, match="collected"):
        session.save(folder)
