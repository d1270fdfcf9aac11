"""Ledgers: rolling unbilled usage up per user and stamping it as billed."""

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gable import fixed, schemas
from gable.functions.temporal import millis_between, moment


class NoUsage(ValueError):
    """A user has nothing to bill."""


def unbilled(usage: DataFrame, upto) -> DataFrame:
    return usage.filter(F.col("ledger_id").isNull() & (F.col("timestamp") <= moment(upto)))


def users_with_usage(users: DataFrame, usage: DataFrame, upto) -> DataFrame:
    """Users with any usage, billed or not, up to a time.

    Usage shrinks to its distinct users first, so a user with very many events
    is one row before the join.
    """
    active = usage.filter(F.col("timestamp") <= moment(upto)).select("user_id").distinct()
    return users.join(active, "user_id", "left_semi")


def ledger_id(user_id: Column, upto, run: int = 0) -> Column:
    """Repeatable id of the ledger of a user at a cutoff; later runs at the same cutoff are counted from 1."""
    return F.sha2(F.concat_ws("|", F.lit("ledger"), user_id.cast("string"), *_text(upto, run)), 256)


def event_id(upto, run: int = 0) -> Column:
    return F.sha2(F.concat_ws("|", F.lit("event"), *_text(upto, run)), 256)


def next_run(records: DataFrame, upto) -> int:
    """How many runs at this cutoff are on record: one look at the records, whatever their number."""
    numbers = records.sparkSession.range(records.count() + 1)
    later = F.concat_ws("|", F.lit("event"), *_text(upto, 0), F.col("id").cast("string"))
    ids = numbers.select("id", F.when(F.col("id") == 0, event_id(upto)).otherwise(F.sha2(later, 256)).alias("record"))
    missing = ids.join(records.select(F.col("id").alias("record")), "record", "left_anti")
    return missing.agg(F.min("id")).first()[0]


def _text(upto, run: int) -> list[Column]:
    cutoff = F.unix_micros(moment(upto)).cast("string")
    return [cutoff, F.lit(str(run))] if run else [cutoff]


def rolled_up(usage: DataFrame, upto, as_of=None, run: int = 0) -> DataFrame:
    """One new ledger for every user with unbilled usage up to the cutoff."""
    return (
        unbilled(usage, upto)
        .groupBy("user_id")
        .agg(
            F.sum("tokens").alias("total_tokens"),
            F.min("timestamp").alias("period_start"),
            F.max("timestamp").alias("period_end"),
        )
        .select(
            ledger_id(F.col("user_id"), upto, run).alias("id"),
            "user_id",
            "total_tokens",
            "period_start",
            "period_end",
            moment(as_of or upto).alias("timestamp"),
            F.lit(None).cast("string").alias("stripe_event_id"),
            event_id(upto, run).alias("aggregation_event_id"),
        )
    )


def ledger_of_user(usage: DataFrame, user_id, upto) -> DataFrame:
    """The ledger of one user; raises when there is nothing to bill."""
    ledger = rolled_up(usage.filter(F.col("user_id") == user_id), upto)
    if ledger.isEmpty():
        raise NoUsage(fixed.NO_USAGE)
    return ledger


def ledgers_of_users(usage: DataFrame, users: DataFrame, wanted: DataFrame, upto) -> DataFrame:
    """Ledgers of the listed users; raises on an unknown user or one without usage."""
    keys = wanted.select("user_id").distinct()
    if not keys.join(users, "user_id", "left_anti").isEmpty():
        raise ValueError("users to bill who are not among the users")
    ledgers = rolled_up(usage.join(keys, "user_id", "left_semi"), upto)
    if not keys.join(ledgers, "user_id", "left_anti").isEmpty():
        raise NoUsage(fixed.NO_USAGE)
    return ledgers


def stamped_by(usage: DataFrame, ledgers: DataFrame) -> DataFrame:
    """Stamp open usage with the given ledgers, one per user, by join."""
    new = ledgers.select(
        F.col("user_id").alias("_user"), F.col("period_end").alias("_until"), F.col("id").alias("_ledger")
    )
    # Users meet by key; time and open state are checked on the match.
    matches = (
        (F.col("user_id") == F.col("_user"))
        & (F.col("timestamp") <= F.col("_until"))
        & F.col("ledger_id").isNull()
    )
    return (
        usage.join(new, matches, "left")
        .withColumn("ledger_id", F.coalesce("ledger_id", "_ledger"))
        .drop("_user", "_until", "_ledger")
    )


def stamped(usage: DataFrame, upto) -> DataFrame:
    """Stamp open usage with the ledgers of `rolled_up` at the same cutoff.

    A ledger ends at the last open event up to the cutoff, so "not after its end"
    and "not after the cutoff" select the same events, and the ledger id follows
    from the user and the cutoff: no join and no shuffle.
    """
    is_open = F.col("ledger_id").isNull() & (F.col("timestamp") <= moment(upto))
    return usage.withColumn(
        "ledger_id", F.when(is_open, ledger_id(F.col("user_id"), upto)).otherwise(F.col("ledger_id"))
    )


def run_items(usage: DataFrame, upto, run: int = 0) -> DataFrame:
    """The events a run bills, each with its ledger: what is open now, up to the cutoff."""
    open_ = unbilled(usage, upto)
    return open_.select(
        "id", "user_id", "tokens", "timestamp", F.col("ledger_id"), "day",
        ledger_id(F.col("user_id"), upto, run).alias("run_ledger"),
    )


def ledger_items(ledgers: DataFrame, usage: DataFrame) -> DataFrame:
    """The usage events each ledger is made of."""
    items = usage.select(
        F.col("id").alias("usage_id"), "api_route", "tokens", "timestamp", "ledger_id"
    )
    return ledgers.select(F.col("id").alias("ledger_id"), "user_id").join(items, "ledger_id")


def event_ledgers(events: DataFrame, ledgers: DataFrame) -> DataFrame:
    """The ledgers each aggregation run produced."""
    return events.select(F.col("id").alias("aggregation_event_id"), "run_time").join(
        ledgers, "aggregation_event_id"
    )


def aggregation_event(
    spark: SparkSession, upto, started: datetime, finished: datetime, run: int = 0
) -> DataFrame:
    """The one-row record of a run, with its duration in milliseconds."""
    return spark.range(1).select(
        event_id(upto, run).alias("id"),
        millis_between(moment(started), moment(finished)).alias("run_time"),
        moment(started).alias("timestamp"),
    ).to(schemas.AGGREGATION_EVENTS)
