"""House listings and details."""

from datetime import date, datetime
from decimal import Decimal

import pytest

from gable import schemas
from gable.operators import extract, houses

EPC = ("lmk_key string, address1 string, address2 string, address3 string, postcode string, "
       "current_energy_rating string, potential_energy_rating string, property_type string, "
       "lodgement_date date, total_floor_area decimal(10,2), uprn bigint")


def _houses(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.HOUSES)


def _epc(key, uprn):
    return (key, "10", "Flat 2", None, "LS1 1AA", "C", "B", "Flat", date(2023, 1, 2), Decimal("70.50"), uprn)


@pytest.fixture
def town(spark):
    return {
        "houses": _houses(
            spark,
            ("house-2", "12", None, "LS1 1AA", "T"),
            ("house-1", "10", "Flat 2", "LS1 1AA", "F"),
            ("house-3", "10", None, None, "D"),
        ),
        "postcodes": spark.createDataFrame(
            [("LS1 1AA", None, "Leeds", "Leeds", "West", "LS1", "LS", "LS1 1")], schemas.POSTCODES
        ),
        "sales": spark.createDataFrame(
            [
                ("t1", 200000, datetime(2020, 5, 1), False, True, "A", "house-1"),
                ("t2", 250000, datetime(2023, 5, 1), False, True, "A", "house-1"),
                ("t0", 250001, datetime(2023, 5, 1), False, True, "A", "house-1"),
                ("t9", 1, datetime(2023, 5, 1), False, True, "A", "elsewhere"),
            ],
            schemas.SALES,
        ),
        "lookup": spark.createDataFrame([("house-1", 123456789)], schemas.UPRN_LOOKUP),
        "certificates": spark.createDataFrame([_epc("epc-1", 123456789), _epc("epc-2", None)], EPC),
    }


def test_listing_of_a_postcode(town):
    rows = houses.houses_of_postcode(town["houses"], "LS1 1AA").collect()
    assert [r["houseid"] for r in rows] == ["house-1", "house-2"]


def test_missing_parts_of_an_address_come_last(spark):
    df = _houses(spark, ("b", "1", None, "P", "D"), ("a", "1", "Flat 1", "P", "D"), ("c", None, "x", "P", "D"))
    assert [r["houseid"] for r in houses.houses_of_postcode(df, "P").collect()] == ["a", "b", "c"]


def test_detail(town):
    found = houses.house_detail(*town.values()).collect()
    rows = {r["houseid"]: r for r in found}
    first = sorted((r for r in found if r["houseid"] == "house-1"), key=lambda r: -(r["year"] or 0))
    assert [s["tui"] for r in first for s in r["previous_sales"]] in (["t0", "t2", "t1"], ["t2", "t1", "t0"])
    assert [e["lmk_key"] for r in first for e in r["linked_epcs"]] == ["epc-1"]
    assert first[0]["street"] is None
    assert rows["house-2"]["previous_sales"] == [] and rows["house-2"]["linked_epcs"] == []
    assert rows["house-2"]["year"] is None
    assert rows["house-3"]["street"] is None and set(rows) == {"house-1", "house-2", "house-3"}


def test_unknown_house_is_empty(town):
    assert houses.house(town["houses"], "does-not-exist").isEmpty()
    assert houses.house(town["houses"], "house-1").count() == 1


def test_detail_of_listed_houses_only(spark, town):
    keys = spark.createDataFrame([("house-2",)], "houseid string")
    few = houses.houses_of_keys(town["houses"], keys)
    rows = houses.house_detail(few, *list(town.values())[1:]).collect()
    assert [r["houseid"] for r in rows] == ["house-2"]


def test_busy_house_comes_by_year_whole_and_in_order(spark, town):
    many = spark.createDataFrame(
        [(f"s{i}", i, datetime(1990 + i % 9, 1, 1 + i % 28), False, True, "A", "house-1") for i in range(500)],
        schemas.SALES,
    )
    rows = houses.house_detail(
        town["houses"], town["postcodes"], many, town["lookup"], town["certificates"]
    ).filter("houseid = 'house-1'").collect()
    sold = [s for r in sorted(rows, key=lambda r: -(r["year"] or 0)) for s in r["previous_sales"]]
    assert len({r["year"] for r in rows}) == len(rows) >= 9
    assert sorted(s["tui"] for s in sold) == sorted(f"s{i}" for i in range(500))
    order = [(-s["date"].timestamp(), s["tui"]) for s in sold]
    assert order == sorted(order)  # over the whole history
    assert [e["lmk_key"] for r in rows for e in r["linked_epcs"]] == ["epc-1"]


def test_street_of_each_house(town):
    rows = houses.with_street(town["houses"], town["postcodes"]).collect()
    assert {r["houseid"] for r in rows} == {"house-1", "house-2", "house-3"}


def test_extraction_filters(spark, town):
    sales = spark.createDataFrame(
        [
            ("in", 1, datetime(2020, 1, 1), False, True, "A", "house-1"),
            ("end", 2, datetime(2020, 12, 31), False, True, "A", "house-1"),
            ("late", 3, datetime(2020, 12, 31, 0, 1), False, True, "A", "house-1"),
            ("category", 4, datetime(2020, 2, 1), False, True, "B", "house-1"),
            ("undated", 5, None, False, True, "A", "house-1"),
            ("other", 6, datetime(2020, 2, 1), False, True, "A", "other"),
            ("untyped", 7, datetime(2020, 2, 1), False, True, "A", "none"),
        ],
        schemas.SALES,
    )
    homes = town["houses"].unionByName(
        _houses(spark, ("other", "1", None, "LS1 1AA", "O"), ("none", "1", None, "LS1 1AA", None))
    )
    rows = extract.sales_frame(
        town["postcodes"], homes, sales, "outcode", "LS1", "2020-01-01", "2020-12-31"
    )
    assert sorted(r["price"] for r in rows.collect()) == [1, 2]
    assert rows.columns == list(extract.COLUMNS)
    everything = extract.sales_frame(town["postcodes"], homes, sales)
    assert sorted(r["price"] for r in everything.collect()) == [1, 2, 3]
    assert extract.sales_frame(town["postcodes"], homes, sales, "outcode", "ls1").isEmpty()


def test_unknown_area_type_is_refused(town):
    with pytest.raises(ValueError, match="no area level .street."):
        extract.sales_frame(town["postcodes"], town["houses"], town["sales"], "street", "x")
