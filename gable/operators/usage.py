"""Usage of priced routes: events, reports, trends and billing history."""

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gable import fixed
from gable.functions.numeric import rounded
from gable.functions.temporal import billing_period, days_before, moment, within


def priced(requests: DataFrame, prices: Mapping[str, int] = fixed.TOKEN_PRICES) -> DataFrame:
    """Usage events of the request log; routes without a price are not billed.

    The price list is a handful of constants, so it is looked up in place.
    """
    price = F.create_map(*[F.lit(x) for x in chain.from_iterable(prices.items())])
    return (
        requests.filter(F.col("api_route").isin(*prices))
        .withColumn("tokens", F.element_at(price, F.col("api_route")).cast("bigint"))
    )


def usage_window(usage: DataFrame, start, end, user_id=None) -> DataFrame:
    """Events from start to end, both included."""
    rows = usage.filter(within("timestamp", start, end))
    if user_id is not None:
        rows = rows.filter(F.col("user_id") == user_id)
    return rows.select("user_id", "api_route", "tokens", "timestamp")


def in_time_order(usage: DataFrame) -> DataFrame:
    """By time; events of one time by their other columns, so a busy moment can be split."""
    return usage.orderBy("timestamp", *[c for c in ("id", "user_id", "api_route", "tokens") if c in usage.columns])


def usage_since(usage: DataFrame, as_of, days: int) -> DataFrame:
    return usage.filter(F.col("timestamp") >= days_before(moment(as_of), days))


def usage_summary(usage: DataFrame, as_of, days: int = 30, users: DataFrame | None = None) -> DataFrame:
    """Tokens, requests and tokens per request of each user over the last days.

    With `users` given, those without usage appear with zeros.
    """
    totals = usage_since(usage, as_of, days).groupBy("user_id").agg(
        F.sum("tokens").alias("total_tokens"), F.count(F.lit(1)).alias("total_requests")
    )
    if users is not None:
        totals = users.select("user_id").join(totals, "user_id", "left")
    zero = F.lit(0).cast("bigint")
    tokens, requests = (F.coalesce(F.col(c), zero) for c in ("total_tokens", "total_requests"))
    mean = F.when(requests > 0, rounded(tokens.cast("double") / requests)).otherwise(0.0)
    return totals.select(
        "user_id",
        tokens.alias("total_tokens"),
        requests.alias("total_requests"),
        mean.alias("average_tokens_per_request"),
        F.lit(days).alias("period_days"),
    )


def top_routes(
    usage: DataFrame, as_of, days: int = 30, limit: int = 10, keys: Sequence[str] = ("user_id",)
) -> DataFrame:
    """The routes with most tokens, ties by name; per user, or overall without keys."""
    totals = (
        usage_since(usage, as_of, days)
        .groupBy(*keys, F.col("api_route").alias("route"))
        .agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("requests"))
    )
    order = [F.desc("tokens"), F.asc("route")]
    if not keys:
        return totals.orderBy(*order).limit(limit)
    return _first_rows(totals, keys, order, limit).drop("position")


def usage_trends(usage: DataFrame, start, end, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """Tokens and requests per day with usage, by date."""
    return (
        usage.filter(within("timestamp", start, end))
        .groupBy(*keys, F.to_date("timestamp").alias("date"))
        .agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("requests"))
        .orderBy(*keys, "date")
    )


def current_period_tokens(usage: DataFrame, users: DataFrame, as_of) -> DataFrame:
    """Tokens of each user in the billing period that holds `as_of`, zero if none."""
    period = billing_period(moment(as_of))
    start, end = period["period_start"], period["period_end"]
    totals = (
        usage.filter(F.col("timestamp").between(start, end))
        .groupBy("user_id")
        .agg(F.sum("tokens").alias("tokens"))
    )
    return users.select("user_id").join(totals, "user_id", "left").select(
        "user_id",
        F.coalesce("tokens", F.lit(0).cast("bigint")).alias("current_period_tokens"),
        start.alias("period_start"),
        end.alias("period_end"),
    )


def history_of_user(ledgers: DataFrame, user_id, limit: int = 12) -> DataFrame:
    return (
        ledgers.filter(F.col("user_id") == user_id).orderBy(F.desc_nulls_first("period_end")).limit(limit)
    )


def billing_history(ledgers: DataFrame, limit: int = 12) -> DataFrame:
    """The newest ledgers of every user, with their position."""
    order = [F.desc_nulls_first("period_end"), F.asc("id")]
    return _first_rows(ledgers, ["user_id"], order, limit)


def _first_rows(rows: DataFrame, keys: Sequence[str], order: list[Column], limit: int) -> DataFrame:
    """Spark keeps only `limit` rows per key and task before the shuffle."""
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("position", position).filter(F.col("position") <= limit)
