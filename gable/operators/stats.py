"""The eight sale statistics, finished from rollups.

Every function returns long rows: keys, [grain, period,] type, value column. The
row of all types carries the label in `fixed.ALL_TYPES`. `prices` and `spans`
hold that row already; `monthly` holds the types only.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gable import fixed
from gable.functions.temporal import MICROS_PER_DAY
from gable.operators import periods, rollups

MONTHLY = {"monthly": fixed.GRAINS["monthly"]}


def mean_of(volume: Column, priced: Column) -> Column:
    return F.when(priced > 0, volume.cast("double") / priced)


def spread_of() -> Column:
    """Sample standard deviation from exact sums; null below two values.

    Falls back to floating point only where the exact products pass 38 digits.
    """
    exact = F.expr(
        "cast(try_subtract(try_multiply(squares, cast(priced as decimal(20,0))),"
        " try_multiply(cast(volume as decimal(38,0)), cast(volume as decimal(38,0)))) as double)"
    )
    count, total = F.col("priced").cast("double"), F.col("volume").cast("double")
    rough = F.col("squares").cast("double") * count - total * total
    spread = F.sqrt(F.greatest(F.coalesce(exact, rough), F.lit(0.0)) / (count * (count - 1)))
    return F.when(F.col("priced") > 1, spread)


def days_of(gap_micros: Column, gaps: Column) -> Column:
    return F.when(gaps > 0, gap_micros.cast("double") / gaps / float(MICROS_PER_DAY))


def mean_price(prices: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return prices.select(*keys, "type", mean_of(F.col("volume"), F.col("priced")).alias("mean_price"))


def std_house_price(prices: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return prices.select(*keys, "type", spread_of().alias("std_price"))


def most_expensive_sale(prices: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per type only; this statistic has no row of all types."""
    by_type = prices.filter(~F.col("type").eqNullSafe(fixed.ALL_TYPES))
    return by_type.select(*keys, "type", F.col("top_price").alias("max_price"))


def count_house_types(spans: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return spans.select(*keys, "type", F.col("houses").alias("count"))


def avg_house_tenancy(spans: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean days between sales. A type without any gap has no row; all types has."""
    return spans.filter((F.col("gaps") > 0) | (F.col("type") == fixed.ALL_TYPES)).select(
        *keys, "type", days_of(F.col("gap_micros"), F.col("gaps")).alias("avg_days")
    )


def count_price(monthly: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sales per month; months without sales inside a type's range are null."""
    rows = periods.period_rollup(monthly, keys, [F.sum("sales").alias("count")], MONTHLY)
    return periods.gaps_filled(rows, keys, ["count"]).drop("grain")


def sale_volume(monthly: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Price sums per grain; only the rows of all types are gap-filled."""
    volume = F.coalesce(F.sum("volume"), F.lit(0).cast("bigint")).alias("volume")
    rows = periods.period_rollup(monthly, keys, [volume])
    return periods.gaps_filled(rows, keys, ["volume"], only_total=True)


def pct_change_price(monthly: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Change of the mean price against a year earlier, per grain."""
    price = mean_of(F.sum("volume"), F.sum("priced")).alias("price")
    rows = periods.period_rollup(monthly, keys, [price])
    changed = rows.withColumn("pct_change", periods.change_over_year(rows, keys, "price"))
    return periods.gaps_filled(changed, keys, ["pct_change"])


#: The label of the whole range beside the grains.
WHOLE = "whole"
_GRAINS = tuple(fixed.GRAINS)
#: The measures each price statistic is finished from, and the grains it is given at.
PRICE_NEEDS = {
    "mean_price": (("priced", "volume"), (WHOLE,)),
    "std_house_price": (("priced", "volume", "squares"), (WHOLE,)),
    "most_expensive_sale": (("top_price",), (WHOLE,)),
    "count_price": (("sales",), ("monthly",)),
    "sale_volume": (("sales", "volume"), _GRAINS),
    "pct_change_price": (("priced", "volume"), _GRAINS),
}
#: Statistics that are whole numbers.
WHOLE_NUMBERS = ("most_expensive_sale", "count_price", "sale_volume", "count_house_types")
SPAN_STATISTICS = ("count_house_types", "avg_house_tenancy")


def _values(*cells: tuple[str, Column, Column]) -> Column:
    """Explode to (statistic, value, amount) for the cells whose condition holds.

    `amount` is the value of a statistic in whole numbers, exact however large.
    """
    listed = [
        F.when(
            kept,
            F.struct(
                F.lit(name).alias("statistic"), value.cast("double").alias("value"),
                (value if name in WHOLE_NUMBERS else F.lit(None)).cast("bigint").alias("amount"),
            ),
        )
        for name, value, kept in cells
    ]
    return F.inline(F.filter(F.array(*listed), lambda cell: cell.isNotNull()))


def together(
    names: Sequence[str], monthly: DataFrame | None, spans: DataFrame | None, keys: Sequence[str] = ()
) -> DataFrame:
    """The named statistics as (statistic, keys, grain, period, type, value, amount).

    One pass over the monthly rollup carries all price statistics: it takes the measures
    and grains they need together, the whole range as one more grain. The house
    statistics come from `spans`. A rollup that no statistic needs may be left out.
    """
    columns = ["statistic", *keys, "grain", "period", "type", "value", "amount"]
    parts = []
    priced = [n for n in names if n in PRICE_NEEDS]
    if priced:
        parts.append(_price_values(priced, monthly, keys).select(*columns))
    is_total = F.col("type") == fixed.ALL_TYPES
    of_spans = {
        "count_house_types": ("count_house_types", F.col("houses"), F.lit(True)),
        "avg_house_tenancy": ("avg_house_tenancy", days_of(F.col("gap_micros"), F.col("gaps")), is_total | (F.col("gaps") > 0)),
    }
    housed = [of_spans[n] for n in SPAN_STATISTICS if n in names]
    if housed:
        bare = [F.lit(None).cast("string").alias("grain"), F.lit(None).cast("date").alias("period")]
        parts.append(spans.select(*keys, *bare, "type", _values(*housed)).select(*columns))
    return reduce(DataFrame.unionByName, parts)


def _price_values(names: Sequence[str], monthly: DataFrame, keys: Sequence[str]) -> DataFrame:
    needed = {m for n in names for m in PRICE_NEEDS[n][0]}
    grains = {g: n for g, n in {**fixed.GRAINS, WHOLE: 0}.items() if any(g in PRICE_NEEDS[x][1] for x in names)}
    measures = [c for name, c in zip(rollups.MEASURES, rollups.summed()) if name in needed]
    rows = periods.period_rollup(monthly, keys, measures, grains)
    carried = [m for m in rollups.MEASURES if m in needed]
    if "pct_change_price" in names:
        rows = rows.withColumn("price", mean_of(F.col("volume"), F.col("priced")))
        rows, carried = rows.withColumn("pct_change", periods.change_over_year(rows, keys, "price")), [*carried, "pct_change"]
    if {"count_price", "sale_volume", "pct_change_price"} & set(names):
        rows = periods.gaps_filled(rows, keys, carried)
    is_total, is_whole = F.col("type") == fixed.ALL_TYPES, F.col("grain") == WHOLE
    cells = {
        "mean_price": lambda: (mean_of(F.col("volume"), F.col("priced")), is_whole),
        "std_house_price": lambda: (spread_of(), is_whole),
        "most_expensive_sale": lambda: (F.col("top_price"), is_whole & ~is_total),
        "count_price": lambda: (F.col("sales"), F.col("grain") == "monthly"),
        "sale_volume": lambda: (
            F.when(F.col("sales").isNotNull(), F.coalesce(F.col("volume"), F.lit(0))),
            ~is_whole & (is_total | F.col("sales").isNotNull()),
        ),
        "pct_change_price": lambda: (F.col("pct_change"), ~is_whole),
    }
    grain = F.when(~is_whole, F.col("grain")).alias("grain")
    return rows.select(*keys, grain, "period", "type", _values(*[(n, *cells[n]()) for n in names]))


def bundle(monthly: DataFrame, spans: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """All eight statistics as (statistic, keys, grain, period, type, value)."""
    return together([*PRICE_NEEDS, *SPAN_STATISTICS], monthly, spans, keys).drop("amount")
