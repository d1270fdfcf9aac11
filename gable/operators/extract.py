"""Sales of an area and a date range, as rows."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gable import fixed
from gable.functions.temporal import within

COLUMNS = ("price", "date", "type", "paon", "saon", "postcode", "street", "town", "houseid")


def checked_area_types(area_types: Sequence[str]) -> list[str]:
    for area_type in area_types:
        if area_type not in fixed.AREA_TYPES:
            raise ValueError(f"no area level {area_type!r}; there are {list(fixed.AREA_TYPES)}")
    return list(area_types)


def counted_sales(sales: DataFrame, start=None, end=None) -> DataFrame:
    """Sales of the kept category inside the range; runs inside the scan.

    The date test also drops sales without a date, and is applied even when the
    range is open for that reason.
    """
    return sales.filter(
        (F.col("ppd_cat") == fixed.KEPT_CATEGORY)
        & F.col("date").isNotNull()
        & within("date", start, end)
    )


def counted_houses(houses: DataFrame) -> DataFrame:
    return houses.filter(F.col("type") != fixed.EXCLUDED_TYPE)


def sales_frame(
    postcodes: DataFrame,
    houses: DataFrame,
    sales: DataFrame,
    area_type: str | None = None,
    area: str | None = None,
    start=None,
    end=None,
    area_columns: Sequence[str] = (),
) -> DataFrame:
    """Sales joined to their house and postcode.

    One area is a filter on `area_type`; all areas at once is no filter, with
    `area_columns` kept as keys for the statistics. Join strategies are left to
    Spark: it broadcasts a side it has sized, and otherwise splits a hot house
    or postcode at run time.
    """
    if area_type is not None:
        postcodes = postcodes.filter(F.col(checked_area_types([area_type])[0]) == area)
    extra = [c for c in checked_area_types(area_columns) if c not in COLUMNS]
    return (
        counted_sales(sales, start, end)
        .select("price", "date", "houseid")
        .join(counted_houses(houses), "houseid")
        .join(postcodes, "postcode")
        .select(*COLUMNS, *extra)
    )


def postcode_sales(houses: DataFrame, sales: DataFrame, start=None, end=None) -> DataFrame:
    """As `sales_frame` keyed by the house's postcode, before areas are joined."""
    return (
        counted_sales(sales, start, end)
        .select("price", "date", "houseid")
        .join(counted_houses(houses).select("houseid", "type", "postcode"), "houseid")
    )


def postcode_levels(postcodes: DataFrame, area_types: Sequence[str]) -> DataFrame:
    """(postcode, levels): the areas a postcode lies in, one per requested level."""
    levels = [
        F.struct(F.lit(t).alias("area_type"), F.col(t).alias("area"))
        for t in checked_area_types(area_types)
    ]
    return postcodes.select("postcode", F.array(*levels).alias("levels"))


def run_query(spark: SparkSession, sql: str, parameters: dict, **tables: DataFrame) -> DataFrame:
    """SQL with named parameters; `{name}` in the text stands for a table."""
    return spark.sql(sql, args=parameters, **tables)
