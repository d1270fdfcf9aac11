"""Every registered query against its SQL, and the shape of the plans."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import oracle_check
from gable import bindings
from gable.operators import extract, rollups
from gable.plans import jobs, oracle
from gable.plans import queries as registered

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = registered.REGISTERED, oracle.SQL
# Jobs that write and read tables; their plans start at the last table.
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups", "PythonUDF")
PAIRING_NODES = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.fixture(scope="module")
def con():
    return oracle_check.connect(SMALL)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(SQL))
def test_result_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    plan = plan_of(df)
    assert not [node for node in (*PYTHON_NODES, *PAIRING_NODES) if node in plan]
    assert oracle_check.difference(df, con, SQL[name]) is None


def test_every_query_has_sql_and_is_registered():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["statistic", "area_type", "area", "grain", "period", "type", "value"]
    assert rows.select("statistic").distinct().count() == 8


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize(
    "name", ["stats_bundle", "house_detail", "frame_statistics", "usage_stamped_by_join", "linked_epcs"]
)
def test_large_side_joins_give_the_same_result(spark, con, no_broadcast, name):
    df = QUERIES[name](spark, SMALL)
    assert "SortMergeJoin" in plan_of(df) and "BroadcastHashJoin" not in plan_of(df)
    assert oracle_check.difference(df, con, SQL[name]) is None


def test_tenancy_combines_sales_before_the_join(spark, no_broadcast):
    """A house with very many sales is one row per task before any shuffle."""
    plan = plan_of(QUERIES["avg_house_tenancy"](spark, SMALL))
    lines = [line.strip(" :+-|") for line in plan.splitlines()]
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "o_orderdate" in line)
    above = [line.split(" ")[0].split("(")[0] for line in lines[:scan]][::-1]
    assert above.index("HashAggregate") < above.index("Exchange") < above.index("SortMergeJoin")
    assert "Window" not in plan


def test_house_spans_of_rows_do_not_trust_the_join_placement(spark, no_broadcast):
    """Rows that lie by house after the join are combined before they are placed again."""
    plan = plan_of(QUERIES["frame_statistics"](spark, SMALL))
    lines = [line.strip(" :+-|") for line in plan.splitlines()]
    at = next(i for i, line in enumerate(lines) if "partial_min(date" in line)
    assert lines[at - 1].startswith("Exchange hashpartitioning(county")


@pytest.fixture
def small_skew_limits(spark, no_broadcast):
    limits = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    }
    before = {name: spark.conf.get(name, None) for name in limits}
    for name, limit in limits.items():
        spark.conf.set(name, limit)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.mark.parametrize("by_rows", [True, False])
def test_join_splits_a_hot_house(spark, small_skew_limits, tmp_path, by_rows):
    """A third of all sales on one house: its partition is read by several tasks."""
    medium = "/root/testdata/sf0.01"
    houses = bindings.houses(spark, medium)
    sales = bindings.sales(spark, medium)
    hot = F.when(F.xxhash64("tui") % 3 == 0, "4").otherwise(F.col("houseid"))
    sales.withColumn("houseid", hot).repartition(8).write.parquet(str(tmp_path / "sales"))
    sales = spark.read.parquet(str(tmp_path / "sales"))
    if by_rows:
        frame = extract.sales_frame(bindings.postcodes(spark, medium), houses, sales)
        rows = rollups.span_rollup(frame, ["postcode"])
    else:
        rows = rollups.price_rollup(extract.postcode_sales(houses, sales), ["postcode"], by_month=True)
    rows.collect()
    assert "skew=true" in plan_of(rows)


def test_periods_shuffle_once_after_the_rollup(spark, no_broadcast):
    plan = plan_of(QUERIES["pct_change_price"](spark, SMALL))
    above = plan[: plan.index("hashpartitioning(area_type")]
    assert above.count("Exchange") == 1 and above.count("Sort [") == 1


def test_stamping_needs_no_shuffle(spark):
    assert "Exchange" not in plan_of(QUERIES["usage_stamped"](spark, SMALL))


def test_scan_reads_only_what_is_needed(spark):
    plan = QUERIES["sales_extract"](spark, SMALL)._jdf.queryExecution().toString()
    assert "o_orderpriority" not in plan.split("== Physical Plan ==")[1]
    assert "GreaterThanOrEqual(o_orderdate" in plan
    plan = QUERIES["mean_price"](spark, SMALL)._jdf.queryExecution().toString()
    assert "o_orderpriority" not in plan.split("== Physical Plan ==")[1]


@pytest.mark.parametrize("name, scans", [("stats_report", 2), ("frame_statistics", 2), ("stats_bundle", 2), ("area_statistics", 2)])
def test_statistics_read_the_sales_once_a_kind(spark, no_broadcast, name, scans):
    """One rollup of prices and one of houses, however many statistics are asked for."""
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert sum("FileScan" in line and "o_orderdate" in line for line in plan.splitlines()) == scans


def test_one_kind_of_statistic_needs_one_rollup(spark, no_broadcast):
    tables = (bindings.postcodes(spark, SMALL), bindings.houses(spark, SMALL), bindings.sales(spark, SMALL), ["county"])
    plan = plan_of(jobs.statistics(["mean_price", "std_house_price", "count_price"], *tables))
    assert sum("FileScan" in line and "o_orderdate" in line for line in plan.splitlines()) == 1
    assert "max(price" not in plan.replace("max(top_price", "max(price")
