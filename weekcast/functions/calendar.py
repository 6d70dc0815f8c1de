"""Calendar column expressions.

* ``temporal_columns``           ISO week, month, quarter, calendar month start / end
                                 (the engineered-table definition)
* ``forecast_calendar_columns``  calendar of a forecast week: the same week / month /
                                 quarter plus year, weekday (Monday = 0), day of month,
                                 day of year, and period flags by day number (month
                                 start = day <= 7, month end = day >= 24) and month
                                 number (quarter start / end)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the forecast-week flags.
QUARTER_START_MONTHS = [1, 4, 7, 10]
QUARTER_END_MONTHS = [3, 6, 9, 12]
MONTH_START_MAX_DAY = 7
MONTH_END_MIN_DAY = 24


def temporal_columns(date: Column) -> dict[str, Column]:
    return {
        "week_of_year": F.weekofyear(date),
        "month": F.month(date),
        "quarter": F.quarter(date),
        "is_month_start": F.dayofmonth(date) == 1,
        "is_month_end": date == F.last_day(date),
    }


def forecast_calendar_columns(d: Column) -> dict[str, Column]:
    dom = F.dayofmonth(d)
    m = F.month(d)
    return {
        "week_of_year": F.weekofyear(d),
        "month": m,
        "quarter": F.quarter(d),
        "year": F.year(d),
        "day_of_week": (F.dayofweek(d) + 5) % 7,
        "day_of_month": dom,
        "day_of_year": F.dayofyear(d),
        "is_month_start": (dom <= MONTH_START_MAX_DAY).cast("int"),
        "is_month_end": (dom >= MONTH_END_MIN_DAY).cast("int"),
        "is_quarter_start": m.isin(QUARTER_START_MONTHS).cast("int"),
        "is_quarter_end": m.isin(QUARTER_END_MONTHS).cast("int"),
    }
