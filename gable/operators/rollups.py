"""Mergeable summaries of sales that all statistics are finished from.

Two summaries cover the eight statistics. Both add up across postcodes, so the
large work (joining and summing sales) is done once per postcode and every area
level is a sum of the small result.
"""

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gable import fixed
from gable.functions.temporal import MICROS_PER_DAY, micros_between
from gable.operators.extract import counted_houses, counted_sales, postcode_levels

MEASURES = ("sales", "priced", "volume", "squares", "top_price")
SPANS = ("houses", "gaps", "gap_micros")


def _recombined(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Make Spark combine rows before it places them by these columns.

    After a sort-merge join on house or postcode the rows already lie by that
    key, and Spark would aggregate them there, a hot key in one task. A key
    computed anew lets it split the join and combine within each task first.
    """
    for column in {"houseid", "postcode"} & set(columns):
        if isinstance(frame.schema[column].dataType, StringType):
            frame = frame.withColumn(column, F.concat(F.col(column), F.lit("")))
    return frame


def price_rollup(frame: DataFrame, keys: Sequence[str] = (), by_month: bool = False) -> DataFrame:
    """Counts and price sums per keys and type, optionally per month.

    Sums of squares are exact decimals, so spread can be finished from sums
    without losing digits. Measures nobody reads are pruned from the plan.
    """
    exact = F.col("price").cast("decimal(19,0)")
    month = [F.trunc("date", "month").alias("month")] if by_month else []
    return _recombined(frame, keys).groupBy(*keys, "type", *month).agg(
        F.count(F.lit(1)).alias("sales"),
        F.count("price").alias("priced"),
        F.sum("price").alias("volume"),
        F.sum((exact * exact).cast("decimal(38,0)")).alias("squares"),
        F.max("price").alias("top_price"),
    )


def summed(names: Sequence[str] = MEASURES) -> list[Column]:
    return [(F.max if n.startswith("top_") else F.sum)(n).alias(n) for n in names]


def span_rollup(frame: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct houses and the time between consecutive sales, per keys and type.

    The gaps between a house's consecutive sales add up to its last date minus
    its first, so min, max and count replace a sorted window: they combine
    before the shuffle and a house with very many sales stays small. Rows of all
    types are summed per house over its types, of which there are as many as codes.
    """
    frame = _recombined(frame, [*keys, "houseid"])
    by_type = frame.groupBy(*keys, "houseid", "type").agg(*_span_of("date"))
    own = F.struct("type", "dated", "first", "last")
    by_house = by_type.groupBy(*keys, "houseid").agg(
        F.collect_list(own).alias("types"),
        F.struct(F.lit(fixed.ALL_TYPES).alias("type"), F.sum("dated").alias("dated"), F.min("first").alias("first"), F.max("last").alias("last")).alias("every"),
    )
    rows = by_house.select(*keys, F.inline(F.concat("types", F.array("every"))))
    if not keys:
        # The row of all types is there even when nothing was sold.
        none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema}
        none["type"] = F.lit(fixed.ALL_TYPES).alias("type")
        rows = rows.unionByName(frame.sparkSession.range(1).select(*none.values()))
    return _spans(rows, [*keys, "type"])


def sale_gaps(frame: DataFrame, keys: Sequence[str] = ("houseid", "type")) -> DataFrame:
    """Each time a house was sold at, its sales, and the days since the time before.

    Further sales at the same time have a gap of zero, so they are only counted. The
    window looks back inside a calendar month; the first time of a month meets the last
    one of the month before it that has any, of which a house has as many as the
    calendar. A busy house is thus spread over its months.
    """
    dates = (
        _recombined(frame, keys)
        .groupBy(*keys, "date")
        .agg(F.count(F.lit(1)).alias("sales"))
        .withColumn("_month", F.trunc("date", "month"))
    )
    inside = F.lag("date").over(Window.partitionBy(*keys, "_month").orderBy("date"))
    months = dates.groupBy(*keys, "_month").agg(F.max("date").alias("_last"))
    before = F.lag("_last").over(Window.partitionBy(*keys).orderBy("_month"))
    months = months.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_month").alias("_of"), before.alias("_before"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col("_month").eqNullSafe(F.col("_of")))
    rows = dates.withColumn("_inside", inside).join(months, same, "left")
    days = micros_between(F.coalesce("_inside", "_before"), F.col("date")) / float(MICROS_PER_DAY)
    return rows.select(*keys, "date", "sales", days.alias("days_since"))


def span_rollup_of_tables(houses: DataFrame, sales: DataFrame, start=None, end=None) -> DataFrame:
    """Houses and gaps by postcode and type, straight from the tables.

    Sales shrink to one row per house before they meet the houses, in the one
    shuffle that join needs anyway. A house has one type, so unlike for
    `span_rollup` all types is the sum of the types, left to `to_areas`.
    """
    by_house = counted_sales(sales, start, end).groupBy("houseid").agg(*_span_of("date"))
    placed = by_house.join(
        counted_houses(houses).select("houseid", "type", "postcode"), "houseid"
    )
    return _spans(placed, ["postcode", "type"])


def _span_of(date: str) -> list[Column]:
    return [F.count(date).alias("dated"), F.min(date).alias("first"), F.max(date).alias("last")]


def _spans(per_house: DataFrame, keys: Sequence[str]) -> DataFrame:
    gap = micros_between(F.col("first"), F.col("last")).cast("decimal(18,0)")
    return per_house.groupBy(*keys).agg(
        F.count("dated").alias("houses"),
        F.sum(F.greatest(F.col("dated") - 1, F.lit(0))).alias("gaps"),
        F.sum(gap).cast("decimal(28,0)").alias("gap_micros"),
    )


def _labels() -> Column:
    """The type of a row and the label it counts towards as well."""
    return F.explode(F.array(F.col("type"), F.lit(fixed.ALL_TYPES)))


def with_total(rollup: DataFrame, keys: Sequence[str] = (), names: Sequence[str] = MEASURES) -> DataFrame:
    """Rows per type plus the row of all types, from one pass over a rollup.

    Without keys the row of all types is there even when nothing was sold.
    """
    if keys:
        return rollup.withColumn("type", _labels()).groupBy(*keys, "type").agg(*summed(names))
    total = rollup.agg(*summed(names)).withColumn("type", F.lit(fixed.ALL_TYPES))
    return rollup.groupBy("type").agg(*summed(names)).unionByName(total)


def to_areas(
    rollup: DataFrame,
    postcodes: DataFrame,
    area_types: Sequence[str],
    names: Sequence[str],
    *more: str,
    total: bool = False,
) -> DataFrame:
    """Sum a rollup by postcode up to (area_type, area), all levels in one job.

    With `total` the row of all types comes out of the same shuffle.
    """
    placed = (
        rollup.join(postcode_levels(postcodes, area_types), "postcode")
        .select(*rollup.columns, F.inline("levels"))
        .filter(F.col("area").isNotNull())
    )
    if total:
        placed = placed.withColumn("type", _labels())
    return placed.groupBy("area_type", "area", "type", *more).agg(*summed(names))
