"""Column functions on literal values."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gable.functions import numeric, temporal, text
from gable.operators.registry import supported


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "postcode, area, outcode, sector",
    [
        ("LS17 3AD", "LS", "LS17", "LS17 3"),
        ("SW1A 1AA", "SW", "SW1A", "SW1A 1"),
        ("M1 1AA", "M", "M1", "M1 1"),
        ("W1A 0AX", "W", "W1A", "W1A 0"),
        ("EC1A 1BB", "EC", "EC1A", "EC1A 1"),
        ("ls17 3ad", "ls", "ls17", "ls17 3"),
        ("XXLS1 1AA", "LS", "LS1", "LS1 1"),
        ("GIR 0AA", "GIR", "GIR", "GIR 0"),
        ("GIR 0AAzz", "GIR", "GIR", "GIR 0"),
    ],
)
def test_postcode(spark, postcode, area, outcode, sector):
    assert value(spark, text.postcode_is_valid(F.lit(postcode)))
    assert tuple(value(spark, text.postcode_parts(F.lit(postcode)))) == (area, outcode, sector)


@pytest.mark.parametrize("postcode", ["NOT A POSTCODE", "", "LS17 3ADX", "LS17 3AD\n", "LS173AD", None])
def test_invalid_postcode(spark, postcode):
    assert value(spark, text.postcode_is_valid(F.lit(postcode).cast("string"))) is False


def test_identifiers_and_flags(spark):
    assert value(spark, text.house_id(F.lit("10"), F.lit(None).cast("string"), F.lit("LS1 1AA"))) == "10LS1 1AA"
    assert value(spark, text.without_ends(F.lit("{hello-tui}"))) == "hello-tui"
    assert value(spark, text.flag_is(F.lit(None).cast("string"), "F")) is False
    assert [value(spark, text.yes_no(F.lit(c))) for c in "YNx"] == [True, False, None]


@pytest.mark.parametrize("raw, kept", [(" c ", "C"), ("A", "A"), ("INVALID!", None), ("", None), ("h", None)])
def test_rating(spark, raw, kept):
    assert value(spark, text.rating(F.lit(raw))) == kept


def test_blank_to_null(spark):
    assert value(spark, text.blank_to_null(F.lit(" \t "))) is None
    assert value(spark, text.blank_to_null(F.lit("  a "))) == "  a "


@pytest.mark.parametrize(
    "raw, kind, parsed",
    [
        (" 12 ", "int", 12), ("\t12\n", "int", 12), ("12.0", "int", None), ("+7", "int", 7), ("abc", "int", None),
        ("99999999999", "int", None), ("99999999999", "bigint", 99999999999), ("", "int", None),
        (" 2.25 ", "decimal(10,2)", Decimal("2.25")), ("1.5f", "decimal(10,2)", None),
        ("1e2", "decimal(10,2)", Decimal("100.00")),
    ],
)
def test_numbers(spark, raw, kind, parsed):
    assert value(spark, numeric.parsed_number(F.lit(raw), kind)) == parsed


def test_dates(spark):
    assert value(spark, temporal.parsed_date(F.lit("2020-01-05"))) == date(2020, 1, 5)
    for bad in ("2020-02-30", "2020-01-05 10:00:00", "", "05/01/2020"):
        assert value(spark, temporal.parsed_date(F.lit(bad))) is None
    assert value(spark, temporal.parsed_datetime(F.lit("2020-01-05 10:11:12"))) == datetime(2020, 1, 5, 10, 11, 12)
    assert value(spark, temporal.parsed_minute(F.lit("2020-01-05 10:11"))) == datetime(2020, 1, 5, 10, 11)
    assert value(spark, temporal.parsed_minute(F.lit("2020-01-05"))) is None


def test_data_id(spark):
    found = value(
        spark,
        text.data_id(
            F.lit("postcode"), F.lit("ls1 1aa"), temporal.moment("2000-01-01"),
            temporal.moment("2001-02-03 04:05:06.000007"),
        ),
    )
    assert found == "POSTCODE_LS11AA:2000-01-0100:00:00-2001-02-0304:05:06.000007"


def test_durations(spark):
    a, b = temporal.moment("2024-01-01"), temporal.moment("2024-01-01 00:00:01.250")
    assert value(spark, temporal.millis_between(a, b)) == 1250


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**6), st.integers(1, 5000)), min_size=200, max_size=400))
def test_rounding_follows_the_exact_binary_value(spark, pairs):
    df = spark.createDataFrame([(a / b,) for a, b in pairs], "x double")
    for row in df.select("x", numeric.rounded(F.col("x")).alias("r")).collect():
        if row["x"] >= 0.125:
            assert row["r"] == round(row["x"], 2)


@pytest.mark.parametrize("x", [2.675, 2.125, 2.375, 1.005, 0.135, 0.0, 10.0, 8.345, 1000000.125])
def test_rounding_of_ties(spark, x):
    assert value(spark, numeric.rounded(F.lit(x))) == round(x, 2)


def test_supported_names():
    assert supported() == [
        "avg_house_tenancy", "count_house_types", "count_price", "mean_price", "most_expensive_sale",
        "pct_change_price", "sale_volume", "std_house_price",
    ]
