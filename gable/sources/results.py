"""Stored statistics: a table of results keyed by their exact input."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gable.functions.temporal import moment
from gable.functions.text import data_id
from gable.operators.normalise import absent
from gable.sources.tables import read_table

SCHEMA = StructType(
    [
        StructField(c, StringType())
        for c in ("key", "data_id", "area_type", "area", "snapshot", "statistic", "result")
    ]
)
ALWAYS = ("0001-01-01 00:00:00", "9999-12-31 23:59:59.999999")


def range_id(area_type: Column, area: Column, start=None, end=None) -> Column:
    """The data id of an area and a range; an open end stands for the extreme date."""
    return data_id(area_type, area, moment(start or ALWAYS[0]), moment(end or ALWAYS[1]))


def exact_key(statistic: str, start=None, end=None, snapshot: str = "") -> Column:
    """The key of `area_type` and `area`: a hash of the exact area, range and data snapshot.

    Areas that differ in case or spaces stay apart, and new data does not meet old results.
    """
    exact = F.concat_ws(
        "\u0001", F.lit(statistic), "area_type", "area",
        F.lit(str(start or ALWAYS[0])), F.lit(str(end or ALWAYS[1])), F.lit(snapshot),
    )
    return F.sha2(exact, 256)


def keyed(results: DataFrame, statistic: str, start=None, end=None, snapshot: str = "") -> DataFrame:
    """Give packed results (area_type, area, result as JSON) their key."""
    return results.select(
        exact_key(statistic, start, end, snapshot).alias("key"),
        range_id(F.col("area_type"), F.col("area"), start, end).alias("data_id"),
        "area_type",
        "area",
        F.lit(snapshot).alias("snapshot"),
        F.lit(statistic).alias("statistic"),
        "result",
    )


def stored(spark: SparkSession, path: str, statistic: str | None = None, identity: str | None = None) -> DataFrame:
    rows = read_table(spark, path, SCHEMA)
    if statistic is not None:
        rows = rows.filter(F.col("statistic") == statistic)
    if identity is not None:
        rows = rows.filter(F.col("data_id") == identity)
    return rows


def store(results: DataFrame, path: str) -> None:
    """Add results whose key is not stored yet."""
    spark = results.sparkSession
    absent(results.select(*SCHEMA.fieldNames()), stored(spark, path), "key").write.mode(
        "append"
    ).parquet(path)


def cached(
    path: str, spark: SparkSession, areas: DataFrame, statistic: str, compute, start=None, end=None, snapshot: str = ""
) -> DataFrame:
    """The stored results of the given areas, those not stored computed and stored first.

    Results are looked up by their exact key. `compute()` gives packed results
    (area_type, area, result); it is not called when every area's result is stored,
    and results stored before stay.
    """
    keys = areas.select(exact_key(statistic, start, end, snapshot).alias("key")).distinct()
    if not absent(keys, stored(spark, path, statistic), "key").isEmpty():
        new = keyed(compute(), statistic, start, end, snapshot)
        store(new.join(keys, "key", "left_semi"), path)
    return stored(spark, path, statistic).join(keys, "key", "left_semi")
