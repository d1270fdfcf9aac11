"""Date and time columns: parsing, calendar periods, billing periods."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from gable import fixed

MICROS_PER_DAY = 86_400_000_000


def moment(value: datetime | str) -> Column:
    """A point in time given by the caller; without a zone it is UTC."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    since_epoch = value - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return F.timestamp_micros(F.lit(since_epoch // timedelta(microseconds=1)).cast("bigint"))


def parsed_date(text: Column) -> Column:
    """Null unless the text is a date without a time part."""
    return F.when(text.rlike(fixed.DATE_LAYOUT), text.try_cast("date"))


def parsed_datetime(text: Column) -> Column:
    return F.when(text.rlike(fixed.SECOND_LAYOUT), text.try_cast("timestamp"))


def parsed_minute(text: Column) -> Column:
    return F.when(text.rlike(fixed.MINUTE_LAYOUT), text.try_cast("timestamp"))


def midnight(date: Column) -> Column:
    return date.cast("timestamp")


def period_start(date: Column, months: int) -> Column:
    """First day of the calendar period of 1, 3, 6 or 12 months.

    Zero months stands for the whole range: one period, without a date.
    """
    if months == 0:
        return F.lit(None).cast("date")
    if months == 6:
        half = F.when(F.month(date) <= 6, 1).otherwise(7)
        return F.make_date(F.year(date), half, F.lit(1))
    return F.trunc(date, {1: "month", 3: "quarter", 12: "year"}[months])


def micros_between(earlier: Column, later: Column) -> Column:
    return F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))


def millis_between(earlier: Column, later: Column) -> Column:
    return F.unix_millis(later) - F.unix_millis(earlier)


def billing_period(as_of: Column) -> Column:
    """Struct of the start and end of the billing period that holds `as_of`.

    It ends on the fixed day of this month, or of the next once that day has
    passed, at the time of day of `as_of`.
    """
    today = F.to_date(as_of)
    passed = F.when(F.dayofmonth(today) > fixed.PERIOD_END_DAY, 1).otherwise(0)
    end_day = F.date_add(F.add_months(F.trunc(today, "month"), passed), fixed.PERIOD_END_DAY - 1)
    end = as_of + F.make_dt_interval(F.datediff(end_day, today))
    return F.struct(
        (end - F.expr(f"interval {fixed.PERIOD_DAYS} days")).alias("period_start"),
        end.alias("period_end"),
    )


def days_before(as_of: Column, days: int) -> Column:
    return as_of - F.expr(f"interval {int(days)} days")


def within(column: str, start=None, end=None) -> Column:
    """Both ends included; an end that is not given does not restrict."""
    kept = F.lit(True)
    if start is not None:
        kept = kept & (F.col(column) >= moment(start))
    if end is not None:
        kept = kept & (F.col(column) <= moment(end))
    return kept
