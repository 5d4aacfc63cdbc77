"""Calendar columns. Business days are local days of one zone; bounds are UTC and half-open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsmart import lexicon as lx

ZONE = "Europe/London"


def ts(value: str) -> Column:
    return F.lit(value).cast("timestamp")


def effective(published: Column, collected: Column) -> Column:
    return F.coalesce(published, collected)


def local_date(instant: Column, zone: str = ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, zone))


def day_start(day: Column, zone: str = ZONE) -> Column:
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def day_end_exclusive(day: Column, zone: str = ZONE) -> Column:
    return F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone)


def day_end_inclusive(day: Column, zone: str = ZONE) -> Column:
    """23:59:59.999999 of the local day."""
    return F.to_utc_timestamp(
        F.date_add(day, 1).cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND"), zone
    )


def window_48h(day: Column, zone: str = ZONE) -> tuple[Column, Column]:
    """Candidate window: 48 hours up to 23:59:59 of the local day."""
    end = F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp") - F.expr("INTERVAL 1 SECOND"), zone)
    return end - F.expr("INTERVAL 48 HOURS"), end


def in_local_day(instant: Column, day: Column, zone: str = ZONE) -> Column:
    return (instant >= day_start(day, zone)) & (instant < day_end_exclusive(day, zone))


def not_future(published: Column, as_of: Column) -> Column:
    return published.isNull() | (published <= as_of)


def hours_between(later: Column, earlier: Column) -> Column:
    """Exact to the microsecond, as a double."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3600000000.0)


def question_dates(question: Column, today: Column, given_from: Column, given_to: Column) -> Column:
    """Date scope of a question: explicit bounds win, then the first matching phrase."""
    q = F.lower(question)

    def any_of(phrases) -> Column:
        out = F.lit(False)
        for p in phrases:
            out = out | q.contains(p)
        return out

    none = F.lit(None).cast("date")
    explicit = given_from.isNotNull() | given_to.isNotNull()
    lo = (
        F.when(q.contains("today"), today)
        .when(q.contains("yesterday"), F.date_sub(today, 1))
        .when(any_of(lx.WEEK_PHRASES), F.date_sub(today, 6))
        .when(any_of(lx.MONTH_PHRASES), F.trunc(today, "month"))
        .otherwise(none)
    )
    hi = (
        F.when(q.contains("today"), today)
        .when(q.contains("yesterday"), F.date_sub(today, 1))
        .when(any_of(lx.WEEK_PHRASES + lx.MONTH_PHRASES), today)
        .otherwise(none)
    )
    return F.struct(
        F.when(explicit, given_from).otherwise(lo).alias("date_from"),
        F.when(explicit, given_to).otherwise(hi).alias("date_to"),
    )


def temporal_label(instant: Column, edition_day: Column) -> Column:
    day = F.to_date(instant)
    fmt = "dd MMMM yyyy"
    return (
        F.when(instant.isNull(), F.concat(F.lit("on "), F.date_format(edition_day, fmt)))
        .when(
            (day == edition_day) & (F.hour(instant) < 6),
            F.concat(F.lit("overnight on "), F.date_format(edition_day, fmt)),
        )
        .when(day == edition_day, F.concat(F.lit("on "), F.date_format(edition_day, fmt)))
        .when(day == F.date_sub(edition_day, 1), F.concat(F.lit("on "), F.date_format(day, fmt)))
        .otherwise(F.concat(F.lit("earlier this week on "), F.date_format(day, fmt)))
    )
