"""Calendar of rounds: deadlines, windows, weeks. Timestamps are UTC; weeks begin on Monday."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The batch hour on Mondays, the first governed deadline, the answering window and the listing lead.
BATCH_HOUR, FIRST_DEADLINE, WINDOW_HOURS, LEAD_DAYS = 12, "2026-09-14 12:00:00", 24, 7


def hours(n: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(n))


def days(n: Column | int) -> Column:
    return F.make_dt_interval(F.lit(n) if isinstance(n, int) else n)


def deadline_for(lock: Column) -> Column:
    """The last Monday noon strictly before the lock."""
    noon = F.date_trunc("week", lock) + hours(BATCH_HOUR)
    return F.when(noon >= lock, noon - days(7)).otherwise(noon)


def governed_by_batch(lock: Column) -> Column:
    return deadline_for(lock) >= F.lit(FIRST_DEADLINE).cast("timestamp")


def window_opens_at(lock: Column) -> Column:
    return lock - hours(WINDOW_HOURS)


def published_at(lock: Column) -> Column:
    return lock - days(LEAD_DAYS)


def horizon_days(lock: Column, release: Column) -> Column:
    return (F.unix_micros(release) - F.unix_micros(lock)) / 86_400_000_000


def batch_of(lock: Column) -> Column:
    return F.concat(F.lit("batch-"), F.date_format(deadline_for(lock), "yyyy-MM-dd"))


def week_end(day: Column) -> Column:
    """The Sunday of a day's week."""
    return F.date_add(day, 6 - F.weekday(day))


def iso_week(day: Column) -> Column:
    """Year and week as 2026-W53."""
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day))


def midpoint(start: Column, end: Column) -> Column:
    return F.date_add(start, F.floor(F.datediff(end, start) / 2).cast("int"))


def month_index(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def effective_deadline(lock: Column) -> Column:
    """A round closes at its own lock; the Monday before it is only the label of its batch."""
    return lock


def freeze_at(lock: Column) -> Column:
    """From when on the answer may exist somewhere: the close. (What a null may read ends at window_opens_at.)"""
    return effective_deadline(lock)


def week_days(end: Column) -> Column:
    """The seven days of the week that ends on a day, whichever weekday that is."""
    return F.sequence(F.date_sub(end, 6), end)


def saturday_week_end(day: Column) -> Column:
    """The Saturday of a day's Sunday week."""
    return F.date_add(day, 6 - (F.weekday(day) + 1) % 7)


def months_back(newest: Column, n: int) -> Column:
    """The n first days of months that end with this one's, oldest first."""
    return F.transform(F.sequence(F.lit(n - 1), F.lit(0)), lambda k: F.add_months(F.trunc(newest, "month"), -k))
