"""What must reach the scan, and what must not appear in the plan."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from tablewright.operators import charts, copies, fills, ordering, preparation, profile, quality, usage

LINES = "/root/testdata/sf0.001/lineitem.parquet"
EVENTS = "/root/testdata/sf0.001/events.parquet"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(autouse=True)
def whole_text(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10000)
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.fixture
def lines(spark):
    return spark.read.parquet(LINES)


def test_aggregate_reads_two_columns_and_combines_before_the_shuffle(lines):
    text = plan(charts.aggregate(lines, "l_returnflag", "l_quantity", top_n=None))
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in text
    assert "partial_sum" in text
    assert "IsNotNull(l_returnflag)" in text


def test_filters_reach_the_scan(lines):
    rules = [
        {"column": "l_quantity", "operator": "Greater Than (>)", "value": 45},
        {"column": "l_shipdate", "operator": "Equals", "value": "1997-05-28"},
    ]
    text = plan(preparation.filter_rows(lines, rules))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", text).group(1)
    assert "GreaterThan(l_quantity,45.0)" in pushed
    assert "GreaterThanOrEqual(l_shipdate" in pushed


def test_period_filter_reaches_the_scan(spark):
    events = spark.read.parquet(EVENTS)
    recent = usage.in_period(events, "ts", datetime.datetime(2024, 1, 29), "Last 7 Days")
    assert "GreaterThanOrEqual(ts" in plan(recent)


def test_no_window_over_the_whole_table(lines, monkeypatch):
    monkeypatch.setattr(ordering, "PER_RANGE", 500)
    monkeypatch.setattr(fills, "PER_RANGE", 500)
    for df in (
        ordering.value_positions(lines, ["l_extendedprice"]),
        ordering.spread(lines, ["l_extendedprice", "l_quantity"]),
        preparation.fill_missing(lines, ["l_quantity"], "ffill", order_by="l_orderkey"),
    ):
        text = plan(df)
        windows = [line for line in text.splitlines() if re.search(r"[+:]- Window \[", line)]
        assert windows
        for line in windows:
            if "__end" in line:
                continue  # one row per range, at most a thousand
                # The bracket after the expressions lists the partitioning; without one it lists the order.
                after = re.search(r"\], \[([^\]]+)\]", line).group(1)
                assert " ASC" not in after and " DESC" not in after, line


def test_counts_are_shuffled_once(lines, monkeypatch):
    df = ordering.spread(lines, ["l_extendedprice"])
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1
    assert "ReusedExchange" in final


def test_value_counts_read_the_table_once(lines, spark):
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", plan(ordering.top_values(lines, ["l_tax", "l_linestatus"])))
    assert schemas == ["l_tax:double,l_linestatus:string"]
    wide = lines.select(*[F.col("l_tax").alias(f"c{i}") for i in range(60)])
    assert plan(profile.column_types(wide)).count("FileScan") <= 3


def test_ranges_hold_about_equally_many_distinct_values(spark, monkeypatch):
    """97 % of the rows lie on 2 % of the values."""
    monkeypatch.setattr(ordering, "PER_RANGE", 5_000)
    hot = spark.range(970_000).select((F.col("id") % 2_000).cast("double").alias("v"))
    df = hot.unionByName(spark.range(98_000).select((F.col("id") + 10_000).cast("double").alias("v")))
    sizes = [r["count"] for r in ordering._counted(df, ["v"], []).groupBy("__range").count().collect()]
    assert len(sizes) >= 10 and max(sizes) <= 4 * sum(sizes) / len(sizes)


def test_copies_are_counted_without_shuffling_rows(lines):
    assert "l_shipdate" not in re.sub(r"FileScan.*", "", plan(profile.duplicate_summary(lines)).split("Exchange")[0])


def test_fill_is_one_plan_with_a_scalar(lines):
    gaps = lines.withColumn("l_tax", F.when(F.col("l_tax") > 0.02, F.col("l_tax")))
    text = plan(preparation.fill_missing(gaps, ["l_tax"], "mean"))
    assert "Subquery" in text and "Join" not in text


def test_first_per_key_sorts_no_table(lines, spark):
    first = preparation.drop_duplicates(lines, ["l_orderkey"], "first", ["l_linenumber", "l_partkey"])
    users = usage.upsert_users(spark.read.parquet(EVENTS), "user_id", "ts", ["event_type", "value"])
    for text in (plan(first), plan(users)):
        assert "SortAggregate" not in text and "partial_m" in text and "__word" in text


def test_rows_without_a_copy_are_not_shuffled(lines):
    """Digests are counted first; what is grouped has passed the bitmap."""
    for df in (quality.duplicate_groups(lines), preparation.drop_duplicates(lines)):
        text = plan(df)
        assert "BroadcastHashJoin" in text and "bit_or" in text and "SortAggregate" not in text
    once = lines.dropDuplicates(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    assert copies.copied_rows(once).count() <= 5
    assert copies.copied_rows(once.unionByName(once.limit(50))).count() >= 100


def test_profile_plan_does_not_grow_with_columns(spark):
    wide = spark.range(100).select(*[(F.col("id") * i).cast("double").alias(f"c{i}") for i in range(60)])
    rows = profile.column_stats(wide, numbers=True).collect()
    assert len(rows) == 60
    assert len(quality.missing_analysis(wide).collect()) == 60
