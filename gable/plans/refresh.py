"""Stored rollups kept current by what changed.

Three tables are kept beside the sales: prices by postcode, type and month; each house's
sales with the first and last date; houses and gaps by postcode and type. Counts, sums and
squares follow a change by adding what is new and taking away what is gone. A maximum, or
the ends of a house's dates, can only grow that way: where the row that held one goes, it
is found again among the sales of that key alone. Of the tables only the buckets with
changed keys are rewritten. Keys that run empty stay with a count of zero, so that their
bucket is replaced as well.

A refresh computes its new rows in full and notes them before it replaces anything, with
the last batch it took in; repeated after a failure, it counts no batch twice.
"""

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gable import schemas
from gable.functions.temporal import micros_between
from gable.operators import rollups, stats
from gable.operators.extract import counted_houses, counted_sales
from gable.session import require_utc, staged
from gable.sources import store, tables, versions

_DEC = T.DecimalType(38, 0)
PRICES = T.StructType([
    T.StructField("postcode", T.StringType()), T.StructField("type", T.StringType()), T.StructField("month", T.DateType()),
    *[T.StructField(c, _DEC if c == "squares" else T.LongType()) for c in rollups.MEASURES],
])
SPANS = T.StructType([
    T.StructField("postcode", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("houses", T.LongType()), T.StructField("gaps", T.LongType()), T.StructField("gap_micros", _DEC),
])
HOUSES = T.StructType([
    T.StructField("houseid", T.StringType()), T.StructField("sales", T.LongType()), T.StructField("dated", T.LongType()),
    T.StructField("first", T.TimestampType()), T.StructField("last", T.TimestampType()),
])
KINDS = {"prices": (PRICES, "postcode"), "house_dates": (HOUSES, "houseid"), "spans": (SPANS, "postcode")}
_NOTE = T.StructType([T.StructField("name", T.StringType()), T.StructField("folder", T.StringType()), T.StructField("upto", T.LongType())])
_APPLIED = T.StructType([T.StructField("upto", T.LongType())])


def refresh(spark: SparkSession, folder: str, houses: DataFrame) -> int:
    """Take the waiting changes of sales into the rollups, fold them in, and return the last batch taken in.

    The first time all sales are new. Houses are taken to keep their postcode and type.
    """
    require_utc(spark)
    _finish(spark, folder)
    path, key = f"{folder}/sales", schemas.KEYS["sales"]
    applied = store.read_table(spark, f"{folder}/rollups/applied", _APPLIED).first()
    applied = -1 if applied is None else applied["upto"]
    # Batches taken in by a refresh that did not come to fold them.
    versions.fold(spark, path, schemas.SALES, key, upto=applied)
    folded, upto, changes = versions.waiting(spark, path, schemas.SALES, key)
    if applied < 0:
        # Nothing is kept yet: every sale in force is a change.
        changes = versions.current(spark, path, schemas.SALES, key).withColumn("sign", F.lit(1))
    elif upto <= applied:
        return applied
    changes = staged(counted_sales(changes), "changes")
    now = counted_sales(versions.current(spark, path, schemas.SALES, key))
    placed = counted_houses(houses).select("houseid", "type", "postcode")
    dates = staged(_dates(spark, folder, changes, now), "house-dates")
    new = {
        "prices": _prices(spark, folder, changes, now, placed),
        "house_dates": dates.select(*HOUSES.fieldNames()),
        "spans": _spans(spark, folder, dates, placed),
    }
    notes = []
    for name, rows in new.items():
        schema, _ = KINDS[name]
        at = f"{folder}/rollups/{name}-new-{uuid.uuid4().hex}"
        rows.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.parquet(at)
        notes.append((name, at, upto))
    store._overwrite(spark, f"{folder}/rollups/note", notes, _NOTE)
    _finish(spark, folder)
    versions.fold(spark, path, schemas.SALES, key, upto=upto)
    return upto


def _finish(spark: SparkSession, folder: str) -> None:
    """Complete a refresh that noted its new rows."""
    notes = store.read_table(spark, f"{folder}/rollups/note", _NOTE).collect()
    for note in notes:
        path, key = f"{folder}/rollups/{note['name']}", KINDS[note["name"]][1]
        store.write_buckets(spark.read.parquet(note["folder"]), path, key, store.layout(spark, path, key), "dynamic")
    if notes:
        store._overwrite(spark, f"{folder}/rollups/applied", [(notes[0]["upto"],)], _APPLIED)
        store._overwrite(spark, f"{folder}/rollups/note", [], _NOTE)
    for note in notes:
        store.remove(spark, note["folder"])


def _kept(spark: SparkSession, folder: str, name: str, touched: DataFrame) -> DataFrame:
    """The stored rows in the buckets of the given keys."""
    schema, key = KINDS[name]
    path = f"{folder}/rollups/{name}"
    buckets = store.layout(spark, path, key)
    return store.only(store.read_buckets(spark, path, schema), store.touched(touched, key, buckets), buckets).drop(store.BUCKET)


def _merged(kept: DataFrame, change: DataFrame, on: Sequence[str]) -> DataFrame:
    """Stored rows beside their changes, whose columns but the keys are called c_..."""
    named = change.withColumnsRenamed({c: f"k_{c}" if c in on else f"c_{c}" for c in change.columns})
    same = [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in on]
    both = kept.withColumn("_kept", F.lit(True)).join(named.withColumn("_new", F.lit(True)), same, "full")
    return both.withColumns({c: F.when(F.col("_kept"), F.col(c)).otherwise(F.col(f"k_{c}")) for c in on})


def _sum(name: str) -> Column:
    zero = F.lit(0)
    return F.coalesce(F.col(name), zero) + F.coalesce(F.col(f"c_{name}"), zero)


def _prices(spark: SparkSession, folder: str, changes: DataFrame, now: DataFrame, placed: DataFrame) -> DataFrame:
    on = ["postcode", "type", "month"]
    sign, exact = F.col("sign"), F.col("price").cast("decimal(19,0)")
    by_key = changes.join(placed, "houseid").groupBy("postcode", "type", F.trunc("date", "month").alias("month"))
    change = staged(
        by_key.agg(
            F.sum(sign).alias("sales"),
            F.sum(F.when(F.col("price").isNotNull(), sign)).alias("priced"),
            F.sum(sign * F.col("price")).alias("volume"),
            F.sum((sign * exact * exact).cast("decimal(38,0)")).alias("squares"),
            F.max(F.when(sign > 0, F.col("price"))).alias("top_price"),
            F.max(F.when(sign < 0, F.col("price"))).alias("gone"),
        ),
        "price-changes",
    )
    both = _merged(_kept(spark, folder, "prices", change), change, on)
    doubtful = F.coalesce(F.col("c_gone") >= F.col("top_price"), F.lit(False))
    rows = staged(
        both.select(
            *on, _sum("sales").alias("sales"), _sum("priced").alias("priced"), _sum("volume").alias("volume"), _sum("squares").alias("squares"),
            F.greatest("top_price", "c_top_price").alias("top_price"), doubtful.alias("doubtful"),
        ),
        "prices",
    )
    open_ = rows.where("doubtful").select(*on)
    if not open_.isEmpty():
        # The highest price went: look among the sales of these postcodes.
        there = now.join(placed.join(open_.select("postcode").distinct(), "postcode", "left_semi"), "houseid")
        tops = rollups.price_rollup(there, ["postcode"], by_month=True).select(*[F.col(c).alias(f"k_{c}") for c in on], F.col("top_price").alias("found"))
        rows = rows.join(tops, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in on], "left")
        rows = rows.withColumn("top_price", F.when(F.col("doubtful"), F.col("found")).otherwise(F.col("top_price")))
    some = F.col("priced") > 0
    return rows.select(*on, "sales", "priced", *[F.when(some, F.col(c)).alias(c) for c in ("volume", "squares", "top_price")])


def _dates(spark: SparkSession, folder: str, changes: DataFrame, now: DataFrame) -> DataFrame:
    """The houses with changes: as stored (old_...) and as they are now."""
    sign, date = F.col("sign"), F.col("date")
    change = staged(
        changes.groupBy("houseid").agg(
            F.sum(sign).alias("sales"),
            F.sum(F.when(date.isNotNull(), sign)).alias("dated"),
            *[f(F.when(sign > 0, date)).alias(n) for n, f in (("first", F.min), ("last", F.max))],
            *[f(F.when(sign < 0, date)).alias(n) for n, f in (("gone_first", F.min), ("gone_last", F.max))],
        ),
        "house-changes",
    )
    both = _merged(_kept(spark, folder, "house_dates", change), change, ["houseid"]).where("_new")
    doubtful = F.coalesce((F.col("c_gone_first") <= F.col("first")) | (F.col("c_gone_last") >= F.col("last")), F.lit(False))
    rows = staged(
        both.select(
            "houseid", _sum("sales").alias("sales"), _sum("dated").alias("dated"),
            F.least("first", "c_first").alias("first"), F.greatest("last", "c_last").alias("last"), doubtful.alias("doubtful"),
            *[F.col(c).alias(f"old_{c}") for c in ("sales", "dated", "first", "last")],
        ),
        "house-dates",
    )
    open_ = rows.where("doubtful").select("houseid")
    if not open_.isEmpty():
        # An end of a house's dates went: look among its sales.
        ends = now.join(open_, "houseid", "left_semi").groupBy(F.col("houseid").alias("k_houseid")).agg(F.min("date").alias("f"), F.max("date").alias("l"))
        rows = rows.join(ends, F.col("houseid") == F.col("k_houseid"), "left")
        rows = rows.withColumns({n: F.when(F.col("doubtful"), F.col(c)).otherwise(F.col(n)) for n, c in (("first", "f"), ("last", "l"))})
    return rows


def _spans(spark: SparkSession, folder: str, dates: DataFrame, placed: DataFrame) -> DataFrame:
    on = ["postcode", "type"]

    def part(prefix: str) -> list[Column]:
        c = lambda name: F.col(f"{prefix}{name}")
        there = F.coalesce(c("sales") > 0, F.lit(False))
        gap = F.coalesce(micros_between(c("first"), c("last")).cast("decimal(18,0)"), F.lit(0))
        values = {"houses": F.lit(1), "gaps": F.greatest(c("dated") - 1, F.lit(0)), "gap_micros": gap}
        return [F.when(there, v).otherwise(0) for v in values.values()]

    moved = [(a - b).alias(n) for n, a, b in zip(rollups.SPANS, part(""), part("old_"))]
    change = staged(dates.join(placed, "houseid").select(*on, *moved).groupBy(*on).agg(*[F.sum(c).alias(c) for c in rollups.SPANS]), "span-changes")
    both = _merged(_kept(spark, folder, "spans", change), change, on)
    return both.select(*on, *[_sum(c).alias(c) for c in rollups.SPANS])


def statistics(spark: SparkSession, folder: str, postcodes: DataFrame, area_types: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The named statistics for every area, finished from the stored rollups alone."""
    keys = ("area_type", "area")
    prices = tables.read_table(spark, f"{folder}/rollups/prices", PRICES).where("sales > 0")
    spans = tables.read_table(spark, f"{folder}/rollups/spans", SPANS).where("houses > 0")
    monthly = rollups.to_areas(prices, postcodes, area_types, rollups.MEASURES, "month")
    return stats.together(names, monthly, rollups.to_areas(spans, postcodes, area_types, rollups.SPANS, total=True), keys)
