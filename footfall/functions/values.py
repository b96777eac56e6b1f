"""Scalar expressions of the domain; all propagate nulls unless they say otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from footfall.config import CO2E_PER_KG, DEFAULT_MEAL_BUFFER, MEAL_WEIGHT_KG, WASTE_REDUCTION_RATE

SLOT_PATTERN = r"(?i)^(\d)(?:st|nd|rd|th)\s+(Sat|Sun)"


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def number_or_null(text: Column) -> Column:
    """A finite number, else null."""
    value = text.cast("string").try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def whole_or_null(text: Column) -> Column:
    """A number cut towards zero, else null."""
    value = number_or_null(text)
    return F.when(F.abs(value) < 2147483648.0, value).cast("int")


def slot_nth(slot: Column) -> Column:
    """The number in a slot such as ``2nd Sat``, else null."""
    return F.regexp_extract(stripped(slot), SLOT_PATTERN, 1).try_cast("int")


def slot_weekday(slot: Column) -> Column:
    """5 for Saturday, 6 for Sunday, else null."""
    name = F.lower(F.regexp_extract(stripped(slot), SLOT_PATTERN, 2))
    return F.when(name == "sat", 5).when(name == "sun", 6)


def safe_location_id(text: Column) -> Column:
    """Lower case, with ``_`` for all but letters, digits, ``_`` and ``-``. Different ids may collide."""
    return F.regexp_replace(F.lower(stripped(text)), r"[^\p{L}\p{N}_-]", "_")


def suggested_meals(predicted: Column, quantile: Column, residual: Column, buffer: Column | None = None) -> Column:
    """The largest of the buffered forecast, the quantile and the forecast with its residual, rounded up."""
    buffer = F.lit(DEFAULT_MEAL_BUFFER) if buffer is None else F.coalesce(buffer, F.lit(DEFAULT_MEAL_BUFFER))
    return F.ceil(F.greatest(predicted * (1 + buffer), F.coalesce(quantile, predicted), predicted + residual)).cast("int")


def waste_avoided(meals: Column) -> Column:
    return meals * F.lit(WASTE_REDUCTION_RATE)


def co2e_avoided(meals: Column) -> Column:
    return waste_avoided(meals) * F.lit(MEAL_WEIGHT_KG) * F.lit(CO2E_PER_KG)


def absolute_error(actual: Column, predicted: Column) -> Column:
    return F.abs(actual.cast("double") - predicted)


def day_of(text: Column) -> Column:
    """The date in the first ten characters, else null."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def instant_or_null(text: Column) -> Column:
    """An ISO-8601 time; without a zone it is UTC (the session's), junk is null."""
    return stripped(text).try_cast("timestamp")


def role_of(text: Column) -> Column:
    """master (also for admin) or staff (also for anything else)."""
    role = F.lower(stripped(F.coalesce(text, F.lit(""))))
    return F.when(role.isin("admin", "master"), "master").otherwise("staff")


def authorized_of(role: Column, listed: Column) -> Column:
    """``*`` for a master; else the listed ids, stripped, without blank ones."""
    own = F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), stripped), lambda x: x != "")
    return F.when(role == "master", F.array(F.lit("*"))).otherwise(own)


def username_key(text: Column) -> Column:
    """What makes two usernames the same."""
    return F.lower(stripped(text))
