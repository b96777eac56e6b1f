"""Calendar expressions. Weekdays count from Monday (0)."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slot_number(day: Column) -> Column:
    """1 for the first seven days of a month, 2 for the next, up to 5."""
    return F.floor((F.dayofmonth(day) - 1) / 7).cast("int") + 1


def slot_label(day: Column) -> Column:
    """Such as ``2nd Sat``; every day that isn't a Saturday says ``Sun``."""
    nth = slot_number(day)
    ending = F.when(nth == 1, "st").when(nth == 2, "nd").when(nth == 3, "rd").otherwise("th")
    return F.concat(nth.cast("string"), ending, F.lit(" "), F.when(F.weekday(day) == 5, "Sat").otherwise("Sun"))


def segment(day: Column) -> Column:
    """sat or sun; null on other days."""
    return F.when(F.weekday(day) == 5, "sat").when(F.weekday(day) == 6, "sun")


def nth_weekday(year: Column, month: Column, weekday: Column, nth: Column) -> Column:
    """The nth such weekday of the month, or null if the month has none."""
    first = F.make_date(year, month, F.lit(1))
    after = ((weekday - F.weekday(first) + 7) % 7 + 7 * (nth - 1)).cast("int")
    return F.when((nth >= 1) & (after < F.dayofmonth(F.last_day(first))), F.date_add(first, after))


def next_service_date(last: Column) -> Column:
    """Sunday after a Saturday; otherwise the next Saturday."""
    return F.when(F.weekday(last) == 5, F.date_add(last, 1)).otherwise(F.next_day(last, "SAT"))


def with_calendar(df: DataFrame, date_col: str = "service_date") -> DataFrame:
    """Add the calendar features of a date."""
    d = F.col(date_col)
    month = F.month(d)
    return df.withColumns(
        {
            "year_num": F.year(d),
            "month_num": month,
            "day_num": F.dayofmonth(d),
            "weekday_num": F.weekday(d),
            "weekofyear": F.weekofyear(d),
            "is_weekend": (F.weekday(d) >= 5).cast("int"),
            "month_sin": F.sin(F.lit(2 * pi) * month / 12),
            "month_cos": F.cos(F.lit(2 * pi) * month / 12),
            "slot": slot_label(d),
            "slot_num": slot_number(d),
            "is_sun": (F.weekday(d) == 6).cast("int"),
        }
    )
