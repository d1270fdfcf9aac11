"""Packing, storing and listing of results."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gable.operators import nest, registry
from gable.sources import results, state


def _counts(spark):
    return spark.createDataFrame(
        [("a", "2000-02-01", "all", 2), ("a", "2000-01-01", "all", None), ("a", "2000-02-01", "D", 2)],
        "area string, period string, type string, count int",
    )


def test_packed_nests_periods_and_types(spark):
    rows = nest.as_json(nest.packed(_counts(spark), ["area"], "count", ["period", "type"])).collect()
    assert json.loads(rows[0]["result"]) == {
        "2000-01-01": {"all": None}, "2000-02-01": {"D": 2, "all": 2}
    }


def test_packed_without_keys(spark):
    rows = nest.as_json(nest.packed(_counts(spark).drop("area"), [], "count", ["period", "type"])).collect()
    assert len(rows) == 1 and list(json.loads(rows[0]["result"])) == ["2000-01-01", "2000-02-01"]


def test_widened(spark):
    rows = nest.widened(_counts(spark), ["area", "period"], "count", ["all", "D"]).collect()
    assert {(r["period"], r["all"], r["D"]) for r in rows} == {
        ("2000-01-01", None, None), ("2000-02-01", 2, 2)
    }


def _packed(spark, area, value):
    return spark.createDataFrame([("county", area, value)], "area_type string, area string, result string")


def test_stored_result_is_returned_without_computing(spark, folder):
    path = f"{folder}/results"
    results.store(results.keyed(_packed(spark, "York", '{"mean_price": 100000}'), "mean_price"), path)
    areas = spark.createDataFrame([("county", "York")], "area_type string, area string")

    def compute():
        raise AssertionError("computed although stored")

    found = results.cached(path, spark, areas, "mean_price", compute).collect()
    assert json.loads(found[0]["result"]) == {"mean_price": 100000}


def test_cached_computes_once_for_each_exact_key(spark, folder):
    path, calls = f"{folder}/results", []

    def run(area, snapshot, value):
        def compute():
            calls.append(value)
            return _packed(spark, area, value)

        areas = spark.createDataFrame([("county", area)], "area_type string, area string")
        (row,) = results.cached(path, spark, areas, "mean_price", compute, snapshot=snapshot).collect()
        return row["area"], row["result"]

    assert run("Leeds", "one", "1") == ("Leeds", "1")
    assert run("Leeds", "one", "2") == ("Leeds", "1")
    assert run("Leeds", "two", "3") == ("Leeds", "3")
    assert run("LEEDS", "one", "4") == ("LEEDS", "4")
    assert run("Leeds", "one", "5") == ("Leeds", "1")
    assert calls == ["1", "3", "4"]


def test_fingerprint_sees_where_nulls_stand(spark):
    rows = [spark.createDataFrame([x], "a string, b string") for x in (("x", None), (None, "x"), ("x", None))]
    found = [state.fingerprint(r).first()["fingerprint"] for r in rows]
    assert found[0] == found[2] != found[1]


def test_added_statistic_passes_through_a_report(spark):
    added = registry.Statistic("lowest", "Lowest", registry.PRICES, lambda r, k: r.select(*k, "type", F.lit(7).alias("least")), ("type",), "least")
    registry.register(added)
    try:
        frame = spark.createDataFrame([("York", "D", 5, datetime(2000, 1, 1), "h")], "county string, type string, price long, date timestamp, houseid string")
        rows = nest.report(registry.run_statistics(frame, ["lowest"], ["county"]), ["county"]).collect()
        assert [(r["statistic"], r["result"]) for r in rows] == [("lowest", '{"D":7,"all":7}')]
    finally:
        del registry.SALE_STATISTICS["lowest"]


def test_storing_again_keeps_the_first(spark, folder):
    path = f"{folder}/results"
    results.store(results.keyed(_packed(spark, "York", "1"), "mean_price"), path)
    results.store(results.keyed(_packed(spark, "York", "2"), "mean_price"), path)
    assert [r["result"] for r in results.stored(spark, path).collect()] == ["1"]


def test_exact_keys_keep_areas_apart_that_share_an_id(spark, folder):
    path = f"{folder}/results"
    for area in ("LS1 1AA", "ls1 1aa"):
        results.store(results.keyed(_packed(spark, area, area), "mean_price"), path)
    rows = results.stored(spark, path).collect()
    assert len(rows) == 2 and len({r["data_id"] for r in rows}) == 1


def test_new_snapshot_does_not_meet_old_results(spark, folder):
    path = f"{folder}/results"
    for snapshot in ("one", "two"):
        results.store(results.keyed(_packed(spark, "York", snapshot), "mean_price", snapshot=snapshot), path)
    assert results.stored(spark, path).count() == 2


def test_catalog_lists_names_sorted(spark):
    names = [r["statistic"] for r in registry.catalog(spark).collect()]
    assert names == sorted(names) and len(names) == 8


def test_a_statistic_can_be_added(spark):
    added = registry.Statistic("lowest", "Lowest", registry.PRICES, lambda r, k: r, ("type",), "least")
    registry.register(added)
    try:
        assert "lowest" in registry.supported()
    finally:
        del registry.SALE_STATISTICS["lowest"]
    with pytest.raises(ValueError):
        registry.lookup(["lowest"])
