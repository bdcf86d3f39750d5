"""Physical plans: pruned scans, no stray shuffles or Python, one statistics pass."""

import pytest

from rinseframe.operators import bins, dedupe, rows, scale, types, values

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(f"{SF}/lineitem.parquet")


@pytest.mark.parametrize(
    "operator",
    [
        lambda df: scale.normalize_all(df),
        lambda df: scale.remove_all_outliers(df),
        lambda df: values.fill_all_mean(df),
        lambda df: values.fill_all_median(df),
        lambda df: values.find_replace(df, "l_returnflag", "F", "X"),
        lambda df: bins.bin_equiwidth(df, "l_quantity", 100),
        lambda df: bins.bin_equifreq(df, "l_extendedprice", 4),
        lambda df: types.change_type(df, "l_quantity", "string"),
        lambda df: rows.delete_where(df, "l_quantity < 10"),
        lambda df: dedupe.replace_duplicates(df, "l_returnflag", {"F": "X"}),
    ],
)
def test_applying_needs_no_shuffle_and_no_python(lineitem, operator):
    text = plan(operator(lineitem))
    assert "Exchange hash" not in text and "NestedLoop" not in text and "Python" not in text
    assert text.count("FileScan") == 1


def test_scan_is_pruned_and_filtered(lineitem):
    text = plan(rows.select_column(scale.remove_outliers(lineitem, "l_tax", 2), "l_quantity"))
    assert "ReadSchema: struct<l_quantity:double,l_tax:double>" in text
    text = plan(rows.select_column(rows.delete_where(lineitem, "l_linenumber > 3"), "l_linenumber"))
    assert "ReadSchema: struct<l_linenumber:int>" in text


def test_statistics_read_only_their_columns(spark, lineitem):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("fit", "fit")
    scale.normalize_all(lineitem)
    spark.sparkContext.setJobGroup("other", "other")
    # one aggregate for all columns: AQE runs its two stages as two jobs at most
    assert len(tracker.getJobIdsForGroup("fit")) <= 2


def test_page_is_a_top_k(lineitem):
    assert "TakeOrderedAndProject" in plan(rows.page(lineitem, 20, 10, [{"column": 5, "dir": "asc"}]))
