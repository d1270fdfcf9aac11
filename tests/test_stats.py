"""The eight statistics on literal frames, and against brute force."""

import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gable import fixed
from gable.operators import registry, rollups, stats

SCHEMA = "price bigint, type string, date timestamp, houseid string"


def day(text):
    return datetime.fromisoformat(text)


def frame(spark, prices, types, dates=None, houses=None):
    n = len(prices)
    dates = dates or ["2000-01-01"] * n
    houses = houses or [f"house{i}" for i in range(n)]
    return spark.createDataFrame(
        [(p, t, day(d) if d else None, h) for p, t, d, h in zip(prices, types, dates, houses)], SCHEMA
    )


def computed(df, name, keys=()):
    return registry.SALE_STATISTICS[name].compute(df, keys)


def by_type(df, value):
    return {r["type"]: r[value] for r in df.collect()}


def cells(df, value, grain=None):
    rows = df.collect()
    return {
        (str(r["period"]), r["type"]): r[value]
        for r in rows
        if grain is None or r["grain"] == grain
    }


def test_mean_is_over_rows(spark):
    df = frame(spark, [100000, 200000, 300000], "DDD")
    assert by_type(computed(df, "mean_price"), "mean_price") == {"all": 200000.0, "D": 200000.0}
    uneven = frame(spark, [100, 100, 400, None], "DDSS")
    assert by_type(computed(uneven, "mean_price"), "mean_price") == {"all": 200.0, "D": 100.0, "S": 400.0}


def test_std_is_sample(spark):
    df = frame(spark, [100000, 200000, 300000, 5], "DDDS")
    found = by_type(computed(df, "std_house_price"), "std_price")
    assert found["D"] == 100000.0
    assert found["S"] is None
    assert found["all"] == pytest.approx(statistics.stdev([100000, 200000, 300000, 5]))


def test_std_keeps_digits_of_close_large_prices(spark):
    prices = [2_000_000_000 + i % 2 for i in range(1000)]
    found = by_type(computed(frame(spark, prices, "D" * 1000), "std_house_price"), "std_price")
    assert found["D"] == pytest.approx(statistics.stdev(prices), rel=1e-12)


def test_most_expensive_has_no_total(spark):
    df = frame(spark, [100000, 200000, 300000, 100000, 100000, 100000], "DDDDDS")
    assert by_type(computed(df, "most_expensive_sale"), "max_price") == {"D": 300000, "S": 100000}


def test_distinct_houses(spark):
    df = frame(spark, [1] * 5, "DDDDS", houses=["house1", "house2", "house3", "house1", "house4"])
    assert by_type(computed(df, "count_house_types"), "count") == {"all": 4, "D": 3, "S": 1}


def test_monthly_count(spark):
    df = frame(spark, [100000, 200000, 300000], "DDD")
    assert cells(computed(df, "count_price"), "count") == {("2000-01-01", "all"): 3, ("2000-01-01", "D"): 3}


def test_monthly_count_gaps_are_null_within_each_types_range(spark):
    df = frame(spark, [1, 1, 1], "DSD", ["2000-01-15", "2000-02-20", "2000-04-02"])
    assert cells(computed(df, "count_price"), "count") == {
        ("2000-01-01", "all"): 1, ("2000-02-01", "all"): 1, ("2000-03-01", "all"): None,
        ("2000-04-01", "all"): 1, ("2000-01-01", "D"): 1, ("2000-02-01", "D"): None,
        ("2000-03-01", "D"): None, ("2000-04-01", "D"): 1, ("2000-02-01", "S"): 1,
    }


def test_sale_volume(spark):
    dates = ["2001-01-01"] * 2 + ["2002-01-01"] * 3
    df = frame(spark, [100000, 200000, 300000, 100000, 100000], "DDDSS", dates)
    rows = computed(df, "sale_volume")
    for grain in fixed.GRAINS:
        found = cells(rows, "volume", grain)
        assert found[("2001-01-01", "all")] == 300000
        assert found[("2002-01-01", "all")] == 500000
        assert found[("2002-01-01", "S")] == 200000
    monthly = cells(rows, "volume", "monthly")
    assert monthly[("2001-06-01", "all")] is None
    assert ("2001-06-01", "D") not in monthly
    assert sum(1 for _, t in monthly if t == "all") == 13


def test_sale_volume_of_unpriced_window_is_zero(spark):
    df = frame(spark, [None], "D")
    assert set(cells(computed(df, "sale_volume"), "volume").values()) == {0}


def test_half_years_start_in_january_and_july(spark):
    df = frame(spark, [1, 1], "DD", ["2000-07-31", "2001-06-30"])
    assert set(cells(computed(df, "sale_volume"), "volume", "half_year")) == {
        ("2000-07-01", "all"), ("2001-01-01", "all"), ("2000-07-01", "D"), ("2001-01-01", "D"),
    }


def test_pct_change_over_a_year_at_every_grain(spark):
    df = frame(spark, [100000, 200000, 300000], "DDD", ["2000-01-01", "2001-01-01", "2002-01-01"])
    rows = computed(df, "pct_change_price")
    for grain in fixed.GRAINS:
        found = cells(rows, "pct_change", grain)
        assert found[("2000-01-01", "all")] is None
        assert found[("2001-01-01", "all")] == 100.0
        assert found[("2002-01-01", "all")] == 50.0
        assert found[("2002-01-01", "D")] == 50.0
    assert cells(rows, "pct_change", "quarterly")[("2000-04-01", "all")] is None


def test_pct_change_from_zero_is_null(spark):
    df = frame(spark, [0, 5], "DD", ["2000-01-01", "2001-01-01"])
    assert cells(computed(df, "pct_change_price"), "pct_change", "yearly")[("2001-01-01", "all")] is None


def test_tenancy(spark):
    dates = ["2001-01-01"] * 3 + ["2002-01-01"] * 3
    houses = ["1", "2", "3"] * 2
    found = by_type(computed(frame(spark, [1] * 6, "D" * 6, dates, houses), "avg_house_tenancy"), "avg_days")
    assert found == {"all": 365.0, "D": 365.0}


def test_tenancy_counts_same_day_resale_and_skips_single_sales(spark):
    dates = ["2001-01-01", "2001-01-01", "2001-01-11", "2005-05-05"]
    found = by_type(
        computed(frame(spark, [1] * 4, "DDDS", dates, ["1", "1", "1", "2"]), "avg_house_tenancy"), "avg_days"
    )
    assert found == {"all": 5.0, "D": 5.0}


def test_tenancy_of_a_house_sold_under_two_types(spark):
    dates = ["2001-01-01", "2001-01-03", "2001-01-05", "2001-01-09"]
    found = by_type(
        computed(frame(spark, [1] * 4, "DSDS", dates, ["1"] * 4), "avg_house_tenancy"), "avg_days"
    )
    assert found == {"all": pytest.approx(8 / 3), "D": 4.0, "S": 6.0}


def test_all_statistics_of_one_frame(spark):
    df = frame(
        spark, [100000, 200000, 300000], "DDS", ["2000-01-01", "2000-02-01", "2000-03-01"], ["1", "1", "2"]
    )
    found = registry.run_statistics(df, registry.supported())
    assert len(found) == 8 and all(rows.count() > 0 for rows in found.values())


def test_empty_frame_gives_no_rows(spark):
    df = frame(spark, [1], "D").limit(0)
    for rows in registry.run_statistics(df, registry.supported(), ["houseid"]).values():
        assert rows.count() == 0


def test_empty_frame_without_keys_keeps_the_total(spark):
    df = frame(spark, [1], "D").limit(0)
    assert by_type(computed(df, "mean_price"), "mean_price") == {"all": None}
    assert by_type(computed(df, "std_house_price"), "std_price") == {"all": None}
    assert by_type(computed(df, "avg_house_tenancy"), "avg_days") == {"all": None}
    assert by_type(computed(df, "count_house_types"), "count") == {"all": 0}
    assert by_type(computed(df, "most_expensive_sale"), "max_price") == {}
    assert cells(computed(df, "count_price"), "count") == {}


def test_gaps_between_dates(spark):
    dates = ["2001-01-01", "2001-01-01", "2001-01-11", "2005-05-05"]
    rows = rollups.sale_gaps(frame(spark, [1] * 4, "DDDS", dates, ["1", "1", "1", "2"]))
    assert {(r["houseid"], str(r["date"])[:10], r["sales"], r["days_since"]) for r in rows.collect()} == {
        ("1", "2001-01-01", 2, None), ("1", "2001-01-11", 1, 10.0), ("2", "2005-05-05", 1, None)
    }


def test_unknown_statistic_is_refused(spark):
    with pytest.raises(ValueError, match="median"):
        registry.run_statistics(frame(spark, [1], "D"), ["mean_price", "median"])


def _brute_force_frame(spark):
    """One house holds a third of all sales, one area most of them."""
    rows = []
    for i in range(3000):
        house = "hot" if i % 3 == 0 else f"h{i % 400}"
        kind = "D" if house == "hot" else "DSTF"[(i % 400) % 4]
        county = "big" if house == "hot" or i % 400 < 300 else f"c{i % 4}"
        rows.append((1000 + (i * 7919) % 5000, kind, datetime(1999, 1, 1) + timedelta(days=(i * 37) % 1500), house, county))
    return rows, spark.createDataFrame(rows, SCHEMA + ", county string")


def test_hot_house_and_area_against_brute_force(spark):
    rows, df = _brute_force_frame(spark)
    groups, gaps, houses = {}, {}, {}
    per_house = {}
    for price, kind, date, house, county in rows:
        per_house.setdefault((county, house, kind), []).append(date)
        for label in (kind, "all"):
            groups.setdefault((county, label), []).append(price)
            houses.setdefault((county, label), set()).add(house)
    for (county, house, kind), dates in per_house.items():
        dates.sort()
        for a, b in zip(dates, dates[1:]):
            for label in (kind, "all"):
                gaps.setdefault((county, label), []).append((b - a).days)
    found = registry.run_statistics(
        df, ["mean_price", "std_house_price", "count_house_types", "avg_house_tenancy"], ["county"]
    )

    def table(name, value):
        return {(r["county"], r["type"]): r[value] for r in found[name].collect()}

    assert table("mean_price", "mean_price") == {k: sum(v) / len(v) for k, v in groups.items()}
    assert table("count_house_types", "count") == {k: len(v) for k, v in houses.items()}
    for key, value in table("avg_house_tenancy", "avg_days").items():
        assert value == pytest.approx(sum(gaps[key]) / len(gaps[key]))
    for key, value in table("std_house_price", "std_price").items():
        assert value == pytest.approx(statistics.stdev(groups[key]))


def test_bundle_agrees_with_single_statistics(spark):
    _, df = _brute_force_frame(spark)
    keys = ["county"]
    rows = stats.bundle(
        rollups.price_rollup(df, keys, by_month=True), rollups.span_rollup(df, keys), keys
    )
    values = {"mean_price": "mean_price", "std_house_price": "std_price", "most_expensive_sale": "max_price",
              "count_house_types": "count", "avg_house_tenancy": "avg_days", "count_price": "count",
              "sale_volume": "volume", "pct_change_price": "pct_change"}
    for name, value in values.items():
        single = computed(df, name, keys).withColumn("value", F.col(value).cast("double"))
        columns = [c for c in ("county", "grain", "period", "type", "value") if c in single.columns]
        bundled = rows.filter(F.col("statistic") == name).select(*columns)
        assert sorted(map(str, bundled.collect())) == sorted(map(str, single.select(*columns).collect())), name
