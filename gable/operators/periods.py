"""Calendar periods: roll-up to grains, gap filling, change over a year."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gable import fixed
from gable.functions.numeric import percent_change
from gable.functions.temporal import period_start


def grain_months(grain: Column) -> Column:
    months = F
    for name, length in fixed.GRAINS.items():
        months = months.when(grain == name, length)
    return months


def period_rollup(
    monthly: DataFrame,
    keys: Sequence[str],
    measures: Sequence[Column],
    grains: Mapping[str, int] = fixed.GRAINS,
) -> DataFrame:
    """Sum months to each grain, per type and over all types.

    A key has at most as many rows as there are months and types, so the rollup
    is placed by key once and this step, the gap filling and the change over a
    year all run on that placement without another shuffle.
    """
    whole = [name for name, length in grains.items() if length == 0]
    if not whole:
        monthly = monthly.filter(F.col("month").isNotNull())
    if keys:
        monthly = monthly.repartition(*keys)
    cells = F.array(
        *[
            F.struct(F.lit(name).alias("grain"), period_start(F.col("month"), length).alias("period"))
            for name, length in grains.items()
        ]
    )
    return (
        monthly.withColumn("type", F.explode(F.array("type", F.lit(fixed.ALL_TYPES))))
        .select("*", F.inline(cells))
        .filter(F.col("period").isNotNull() | F.col("grain").isin(whole))
        .groupBy(*keys, "type", "grain", "period")
        .agg(*measures)
    )


def gaps_filled(rows: DataFrame, keys: Sequence[str], values: Sequence[str], only_total: bool = False) -> DataFrame:
    """Add the missing periods between a group's first and last, values null.

    Each row also emits the empty periods up to the next row of its group, so no
    list of periods is joined back. `only_total` leaves the types unfilled. A row
    without a period is kept as it is.
    """
    group = Window.partitionBy(*keys, "type", "grain").orderBy("period")
    months = grain_months(F.col("grain"))
    until = F.add_months(F.lead("period").over(group), -months)
    if only_total:
        until = F.when(F.col("type") == fixed.ALL_TYPES, until)
    slots = F.sequence(
        F.col("period"), F.coalesce(until, F.col("period")), F.make_ym_interval(F.lit(0), months)
    )
    is_own = F.coalesce(F.col("slot"), F.lit(0)) == 0
    held = [F.when(is_own, F.col(v)).alias(v) for v in values]
    return (
        rows.withColumn("slots", slots)
        .select(*keys, "type", "grain", *values, F.posexplode_outer("slots").alias("slot", "period"))
        .select(*keys, "type", "grain", "period", *held)
    )


def change_over_year(rows: DataFrame, keys: Sequence[str], value: str) -> Column:
    """Percent change of `value` to the same period a year earlier, null if that has no row.

    A frame of exactly one year back finds it at any grain and whatever periods are
    missing, in the order that filling the gaps uses as well.
    """
    group = ", ".join(f"`{c}`" for c in (*keys, "type", "grain"))
    frame = "RANGE BETWEEN INTERVAL '1' YEAR PRECEDING AND INTERVAL '1' YEAR PRECEDING"
    before = F.expr(f"first(`{value}`) OVER (PARTITION BY {group} ORDER BY period {frame})")
    return percent_change(F.col(value), before)
