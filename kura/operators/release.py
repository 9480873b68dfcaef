"""Release state and date rules; today is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def status(date: Column, precision: Column, today: Column) -> Column:
    """unknown without a date; by month available only once the month is over; else available up to today."""
    month = F.date_trunc("month", date) < F.date_trunc("month", today)
    return F.when(date.isNull(), "unknown").when(F.when(precision == "month", month).otherwise(date <= today), "available").otherwise("scheduled")


def display(stored: Column, date: Column, precision: Column, source: Column, checked_utc: Column, now_utc: Column, zone: str = "Asia/Taipei") -> Column:
    """What is shown: a due date counts as confirmed only when the product was checked on or after that day."""
    local = lambda c: F.to_date(F.from_utc_timestamp(c.cast("timestamp"), zone))
    due = F.when(precision == "month", F.last_day(F.to_date(date))).otherwise(F.to_date(date))
    confirmed = (source == "product") & (checked_utc <= now_utc) & (local(checked_utc) >= due)
    over = F.when(F.coalesce(confirmed, F.lit(False)), "date_confirmed").otherwise("pending_confirmation")
    return F.when(stored.isin("cancelled", "delayed"), stored).when(due.isNull(), stored).when(due <= local(now_utc), over).otherwise("scheduled")


def recheck_days(date: Column, today: Column) -> Column:
    """Days until the next check: a week for releases more than thirty days ahead, else one."""
    return F.when(date > F.date_add(today, 30), 7).otherwise(1)


def backoff_days(failures: Column) -> Column:
    return F.least(F.pow(F.lit(2), F.least(failures - 1, F.lit(3))), F.lit(7)).cast("int")


def one_year_before(date: Column) -> Column:
    """The same day a year earlier; of February 29 the 28."""
    return F.add_months(date, -12)
