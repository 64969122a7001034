"""Calendar columns: fiscal period rules and relative date ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quarter ends as month*100+day and what they are called.
QUARTER_ENDS = {331: ("Q1", 1), 630: ("H1", 2), 930: ("Q3", 3), 1231: ("FY", 4)}
RELATIVE_RANGES = ("今天", "昨天", "本周", "上周", "本月", "上月", "今年")


def month_day(date: Column) -> Column:
    return F.month(date) * 100 + F.day(date)


def period_type(date: Column) -> Column:
    picked = F
    for code, (label, _) in QUARTER_ENDS.items():
        picked = picked.when(month_day(date) == code, label)
    return picked.otherwise("OTHER")


def fiscal_quarter(date: Column) -> Column:
    picked = F
    for code, (_, quarter) in QUARTER_ENDS.items():
        picked = picked.when(month_day(date) == code, F.lit(quarter))
    return picked


def months_in_period(date: Column) -> Column:
    return F.when(F.month(date).isin(3, 6, 9, 12), F.month(date))


def quarter_end(date: Column) -> Column:
    """Last day of the calendar quarter the date falls in."""
    return F.last_day(F.add_months(F.trunc(date, "quarter"), 2))


def same_day_years_later(date: Column, years: int) -> Column:
    """All dates whose "minus ``years`` years" is ``date``.

    Subtracting whole years from 29 February gives 28 February, so a 28 February base answers for
    both days of a leap year and a 29 February base answers for none.
    """
    later = F.add_months(date, 12 * years)
    return (
        F.when(month_day(date) == 229, F.array().cast("array<date>"))
        .when(month_day(date) == 228, F.array_distinct(F.array(later, F.last_day(later))))
        .otherwise(F.array(later))
    )


def in_month(date: Column, month_start: Column) -> Column:
    """Half-open month: first day <= date < first day of the next month."""
    return (date >= month_start) & (date < F.add_months(month_start, 1))


def up_to_month(date: Column, month_start: Column) -> Column:
    """"Up to month" fixes the upper bound only and includes that whole month."""
    return date < F.add_months(month_start, 1)


def relative_range(expression: str, today: Column) -> tuple[Column, Column]:
    """First and last day (both inclusive) of a relative range; weeks run Monday to Sunday."""
    monday = F.to_date(F.date_trunc("week", today))
    month = F.trunc(today, "month")
    ranges = {
        "今天": (today, today),
        "昨天": (F.date_sub(today, 1), F.date_sub(today, 1)),
        "本周": (monday, F.date_add(monday, 6)),
        "上周": (F.date_sub(monday, 7), F.date_sub(monday, 1)),
        "本月": (month, F.last_day(today)),
        "上月": (F.add_months(month, -1), F.date_sub(month, 1)),
        "今年": (F.trunc(today, "year"), F.last_day(F.add_months(F.trunc(today, "year"), 11))),
    }
    if expression not in ranges:
        raise ValueError(f"unknown range {expression!r}, expected one of {RELATIVE_RANGES}")
    return ranges[expression]


def local_day(utc: Column, zone: str = "Asia/Shanghai") -> Column:
    """Calendar day of a UTC wall-clock timestamp in another zone."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc.cast("timestamp_ntz")))
