"""Calendar attributes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (month, day) of the holidays.
HOLIDAYS = ((1, 1), (12, 25), (1, 26), (4, 25))
FISCAL_START = 7


def date_key(d: Column) -> Column:
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("long")


def attributes(d: Column) -> dict[str, Column]:
    """All columns of a date dimension by name. Weeks are ISO weeks, days of the week count from Sunday, 0."""
    month, weekday = F.month(d), F.dayofweek(d) - 1
    holiday = F.lit(False)
    for m, day in HOLIDAYS:
        holiday = holiday | ((month == m) & (F.dayofmonth(d) == day))
    return {
        "date_actual": d,
        "date_key": date_key(d),
        "year": F.year(d).cast("long"),
        "quarter": F.quarter(d).cast("long"),
        "month": month.cast("long"),
        "week": F.weekofyear(d).cast("long"),
        "day_of_month": F.dayofmonth(d).cast("long"),
        "day_of_week": weekday.cast("long"),
        "day_name": F.date_format(d, "EEEE"),
        "month_name": F.date_format(d, "MMMM"),
        "is_weekend": weekday.isin(0, 6),
        "fiscal_year": (F.year(d) + F.when(month >= FISCAL_START, 1).otherwise(0)).cast("long"),
        "fiscal_quarter": (F.floor(F.pmod(month - FISCAL_START, F.lit(12)) / 3) + 1).cast("int"),
        "is_holiday": holiday,
    }
