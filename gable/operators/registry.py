"""Statistics by name: the plug-in interface and the calls that use it."""

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gable.operators import rollups, stats


PRICES, MONTHS, SPANS = "prices", "months", "spans"


def _prices(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rollups.with_total(rollups.price_rollup(frame, keys), keys)


def _by_month(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rollups.price_rollup(frame, keys, by_month=True)


_PREPARE = {PRICES: _prices, MONTHS: _by_month, SPANS: rollups.span_rollup}


@dataclass(frozen=True)
class Statistic:
    """A named statistic.

    `kind` names the rollup it is finished from; `finish(rollup, keys)` turns a
    rollup, of rows or of tables, into the result. `levels` and `value` say how the
    result nests in a report, outermost level first.
    """

    name: str
    description: str
    kind: str
    finish: Callable[[DataFrame, Sequence[str]], DataFrame]
    levels: tuple[str, ...]
    value: str
    deprecated: bool = False
    deprecated_in: str | None = None

    def compute(self, frame: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        return self.finish(_PREPARE[self.kind](frame, keys), keys)


# Names and descriptions of the supported statistics.
SALE_STATISTICS = {
    s.name: s
    for s in (
        Statistic("mean_price", "Average sale price", PRICES, stats.mean_price, ("type",), "mean_price"),
        Statistic(
            "sale_volume", "Total sales volume for time periods 1mo, 3mo, 6mo, and 12mo", MONTHS, stats.sale_volume,
            ("grain", "period", "type"), "volume",
        ),
        Statistic("count_price", "Count the total sales", MONTHS, stats.count_price, ("period", "type"), "count"),
        Statistic("count_house_types", "Count different types of houses", SPANS, stats.count_house_types, ("type",), "count"),
        Statistic("most_expensive_sale", "Most expensive sale", PRICES, stats.most_expensive_sale, ("type",), "max_price"),
        Statistic("pct_change_price", "The percent change of a sales price", MONTHS, stats.pct_change_price, ("grain", "period", "type"), "pct_change"),
        Statistic("std_house_price", "Standard deviation of sale price", PRICES, stats.std_house_price, ("type",), "std_price"),
        Statistic("avg_house_tenancy", "Average tenancy for houses in that area", SPANS, stats.avg_house_tenancy, ("type",), "avg_days"),
    )
}


def register(statistic: Statistic) -> None:
    SALE_STATISTICS[statistic.name] = statistic


def supported() -> list[str]:
    return sorted(SALE_STATISTICS)


def unsupported(names: Sequence[str]) -> list[str]:
    return sorted(set(names) - set(SALE_STATISTICS))


def lookup(names: Sequence[str]) -> list[Statistic]:
    unknown = unsupported(names)
    if unknown:
        raise ValueError(f"unsupported_stats: {unknown}")
    return [SALE_STATISTICS[name] for name in names]


def run_statistics(
    frame: DataFrame, names: Sequence[str], keys: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """Each named statistic over one extraction, one result per name."""
    return {s.name: s.compute(frame, keys) for s in lookup(names)}


def run_together(frame: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The named statistics over one extraction as (statistic, keys, grain, period, type, value, amount).

    Those built in share one rollup of prices and one of houses; a statistic registered
    by the caller is computed as it says and added.
    """
    found = lookup(names)
    own = [s for s in found if s.name in stats.PRICE_NEEDS or s.name in stats.SPAN_STATISTICS]
    kinds, parts = {s.kind for s in own}, []
    if own:
        monthly = _by_month(frame, keys) if kinds & {PRICES, MONTHS} else None
        parts.append(stats.together([s.name for s in own], monthly, rollups.span_rollup(frame, keys) if SPANS in kinds else None, keys))
    for s in (s for s in found if s not in own):
        rows = s.compute(frame, keys)
        levels = [F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in (("grain", "string"), ("period", "date"), ("type", "string"))]
        parts.append(rows.select(F.lit(s.name).alias("statistic"), *keys, *levels, F.col(s.value).cast("double").alias("value"), F.lit(None).cast("bigint").alias("amount")))
    return reduce(DataFrame.unionByName, parts)


def catalog(spark: SparkSession) -> DataFrame:
    rows = [
        (s.name, s.description, s.deprecated, s.deprecated_in)
        for s in (SALE_STATISTICS[name] for name in supported())
    ]
    return spark.createDataFrame(
        rows, "statistic string, description string, deprecated boolean, deprecated_in string"
    )


def rejected_requests(requests: DataFrame, spark: SparkSession) -> DataFrame:
    """Requests for a statistic that does not exist."""
    return requests.join(catalog(spark).select("statistic"), "statistic", "left_anti")
