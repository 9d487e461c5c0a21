"""When something is due or old, as expressions over timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def age_days(finished: Column, now: Column) -> Column:
    """Whole days of 24 hours between two moments, not calendar days."""
    return F.floor((F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(finished.cast("timestamp"))) / 86400).cast("int")


def is_stale(finished: Column, now: Column) -> Column:
    return age_days(finished, now) >= 1


def sweep_is_due(last: Column, now: Column, weekday: int, overdue_days: int = 7) -> Column:
    """The weekly sweep: never made, overdue, or it is the day (0 is Monday) and it wasn't made on this day."""
    overdue = now >= last + F.make_dt_interval(F.lit(overdue_days))
    return last.isNull() | overdue | ((F.weekday(now) == weekday) & (F.to_date(last) != F.to_date(now)))


def next_sweep(last: Column, now: Column, days: int = 7) -> Column:
    """The earliest date of the next sweep; null says that it comes with the next run, as it is overdue or was never made."""
    due = last + F.make_dt_interval(F.lit(days))
    return F.when(due > now, F.to_date(due))


def run_reads(status: Column, started: Column, finished: Column, now: Column, dead_after_hours: int = 6) -> Column:
    """How a run reads in a list: its status once it has ended; before, "running" until its age or its status says "abandoned"."""
    alive = (status != "abandoned") & (now <= started + F.make_dt_interval(F.lit(0), F.lit(dead_after_hours)))
    return F.when(finished.isNotNull(), status).when(alive, "running").otherwise("abandoned")
