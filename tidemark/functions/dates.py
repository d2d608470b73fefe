"""Dates and times as filings write them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_date(column: Column | str) -> Column:
    """YYYYMMDD, an ISO date or an ISO date and time as a date; null if none."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.coalesce(F.try_to_date(F.when(F.length(text) == 8, text), "yyyyMMdd"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))


def business_days_between(start: Column, end: Column) -> Column:
    """Weekdays strictly between two dates; 0 if none. By arithmetic on whole weeks, so the cost doesn't grow with the distance."""

    def weekdays_until(d):  # weekdays from Monday 1969-12-29 up to and with d
        n = F.datediff(d, F.lit("1969-12-28").cast("date"))
        return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))

    return F.greatest(weekdays_until(F.date_sub(end, 1)) - weekdays_until(start), F.lit(0)).cast("long")


def index_quarter(date: Column) -> Column:
    return F.quarter(date)


def index_path(date: Column) -> Column:
    """Place of a day's index: year, quarter, master.YYYYMMDD.idx."""
    return F.concat(F.year(date).cast("string"), F.lit("/QTR"), F.quarter(date).cast("string"), F.lit("/master."), F.date_format(date, "yyyyMMdd"), F.lit(".idx"))


def dates_to_scan(cursor: dt.date | None, today: dt.date) -> list[dt.date]:
    """Every day from the cursor to today; today alone if the cursor is unset or ahead."""
    if cursor is None or cursor > today:
        return [today]
    return [cursor + dt.timedelta(days=i) for i in range((today - cursor).days + 1)]


def days_behind(at: Column, today: Column) -> Column:
    return F.datediff(today, any_date(at))
