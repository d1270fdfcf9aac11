"""Result shapes: nested maps per key, and periods with a column per type."""

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gable.operators import registry, stats


def _map_of(key: str, value: Column | str) -> Column:
    """Entries sorted by key; sorting makes the packed text repeatable."""
    entries = F.collect_list(F.struct(F.col(key).alias("key"), F.col(value).alias("value")))
    by_key = F.array_sort(
        entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    )
    return F.map_from_entries(by_key)


def packed(long_rows: DataFrame, keys: Sequence[str], value: str, path: Sequence[str]) -> DataFrame:
    """Fold long rows into one nested map per key, outermost level first.

    `path` names the levels, such as ("grain", "period", "type"). Each level
    holds the calendar periods or types of one key, so no list grows with sales.
    """
    rows = long_rows
    for level in path:
        rows = rows.withColumn(level, F.coalesce(F.col(level).cast("string"), F.lit("null")))
    outer, inner = list(path), value
    while outer:
        level = outer.pop()
        rows = rows.groupBy(*keys, *outer).agg(_map_of(level, inner).alias("result"))
        inner = "result"
    return rows


def report(found: Mapping[str, DataFrame], keys: Sequence[str], start=None, end=None) -> DataFrame:
    """One row per key and statistic: its nested result as JSON, and the range asked for."""
    parts = []
    for name, rows in found.items():
        (statistic,) = registry.lookup([name])
        nested = as_json(packed(rows, keys, statistic.value, statistic.levels))
        parts.append(nested.select(*keys, F.lit(name).alias("statistic"), "result"))
    return reduce(DataFrame.unionByName, parts).select(
        *keys, "statistic", "result",
        F.lit(start).cast("string").alias("start_date"),
        F.lit(end).cast("string").alias("end_date"),
    )


def report_together(long_rows: DataFrame, keys: Sequence[str], start=None, end=None) -> DataFrame:
    """The rows of `report` from statistics that were computed together.

    Every statistic is folded by grain, period and type at once; levels it does not have
    hold a single entry, which is taken off again. Whole numbers stay exact.
    """
    levels = ("grain", "period", "type")
    rows = long_rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in levels})
    for depth in (2, 1, 0):
        folded = rows.groupBy(*keys, "statistic", *levels[:depth])
        rows = folded.agg(*[_map_of(levels[depth], c).alias(c) for c in ("value", "amount")])
    text = F
    for s in registry.SALE_STATISTICS.values():
        nested = F.col("amount" if s.name in stats.WHOLE_NUMBERS else "value")
        for i, level in enumerate(levels):
            if level not in s.levels:
                nested = _without(nested, [x for x in levels[:i] if x in s.levels])
        text = text.when(F.col("statistic") == s.name, F.to_json(nested, {"ignoreNullFields": "false"}))
    return rows.select(
        *keys, "statistic", text.alias("result"),
        F.lit(start).cast("string").alias("start_date"),
        F.lit(end).cast("string").alias("end_date"),
    )


def _without(nested: Column, outer: Sequence[str]) -> Column:
    """Take a level with a single entry off, below the given levels."""
    if not outer:
        return F.element_at(F.map_values(nested), 1)
    return F.transform_values(nested, lambda _, inner: _without(inner, outer[1:]))


def as_json(nested: DataFrame, column: str = "result") -> DataFrame:
    return nested.withColumn(column, F.to_json(column, {"ignoreNullFields": "false"}))


def widened(
    long_rows: DataFrame, keys: Sequence[str], value: str, types: Sequence[str]
) -> DataFrame:
    """One row per key and period with a column per type; listed types avoid a pre-scan."""
    return long_rows.groupBy(*keys).pivot("type", list(types)).agg(F.first(value))
