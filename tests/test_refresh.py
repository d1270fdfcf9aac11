"""Rollups kept current by changes against statistics computed anew."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gable import schemas
from gable.operators import registry
from gable.plans import jobs, refresh
from gable.sources import store, versions

RECORD = T.StructType([*schemas.SALES.fields, T.StructField("row_class", T.StringType()), T.StructField("at", T.StringType())])
LEVELS = ["county", "postcode"]


@pytest.fixture
def places(spark):
    postcodes = spark.createDataFrame([(f"P{i}", "s", "t", "d", f"C{i % 2}", "o", "a", "x") for i in range(3)], schemas.POSTCODES)
    houses = spark.createDataFrame([(f"h{i}", "1", "", f"P{i % 3}", "DSTO"[i % 4]) for i in range(8)], schemas.HOUSES)
    return postcodes, houses


def append(spark, folder, rows):
    records = [(t, p, d, True, True, c, h, k, f"{i:04d}") for i, (t, p, d, c, h, k) in enumerate(rows)]
    versions.append(spark.createDataFrame(records, RECORD), f"{folder}/sales", schemas.SALES, "tui", ["at"], 2)


def rows_of(df):
    shown = df.select("statistic", "area_type", "area", "grain", "period", "type", F.round("value", 6).alias("value"))
    return sorted(map(tuple, shown.collect()), key=str)


def kept(spark, folder, postcodes):
    return rows_of(refresh.statistics(spark, folder, postcodes, LEVELS, registry.supported()))


def anew(spark, folder, postcodes, houses):
    sales = versions.current(spark, f"{folder}/sales", schemas.SALES, "tui")
    return rows_of(jobs.all_statistics(postcodes, houses, sales, LEVELS))


def some_records(rng, count):
    return [
        (
            f"t{rng.randrange(14)}", rng.choice([None, 5, 7, 7, 9]), rng.choice([None, datetime(2020, rng.randrange(1, 4), rng.randrange(1, 28))]),
            rng.choice("AAAB"), f"h{rng.randrange(9)}", rng.choice(["ADDITION", "CHANGE", "CHANGE", "DELETE"]),
        )
        for _ in range(count)
    ]


def test_equal_after_every_batch(spark, folder, places):
    postcodes, houses = places
    rng = random.Random(5)
    for count in (40, 12, 9):
        append(spark, folder, some_records(rng, count))
        refresh.refresh(spark, folder, houses)
        assert kept(spark, folder, postcodes) == anew(spark, folder, postcodes, houses)


def test_cut_off_refreshes_count_nothing_twice(spark, folder, places, monkeypatch):
    """One refresh dies before its rows are in place, one before its batches are folded in."""
    postcodes, houses = places
    rng = random.Random(6)
    append(spark, folder, some_records(rng, 40))
    refresh.refresh(spark, folder, houses)
    append(spark, folder, some_records(rng, 10))

    def fail(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "write_buckets", fail)
        with pytest.raises(RuntimeError):
            refresh.refresh(spark, folder, houses)
    with monkeypatch.context() as m:
        m.setattr(versions, "fold", lambda *_, upto, **__: fail() if upto > 0 else [])
        with pytest.raises(RuntimeError):
            refresh.refresh(spark, folder, houses)
    append(spark, folder, some_records(rng, 8))
    refresh.refresh(spark, folder, houses)
    assert kept(spark, folder, postcodes) == anew(spark, folder, postcodes, houses)
    assert refresh.refresh(spark, folder, houses) == 2
