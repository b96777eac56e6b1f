"""Hourly weather to daily features of the service window, and its use with attendance and targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.config import DEFAULT_TIMEZONE, OBSERVATION_HOURS, WEATHER_FEATURES

#: Daily feature and the hourly measure it is the mean of.
MEANS = {"temp_10_13": "temperature_2m", "apparent_temp_10_13": "apparent_temperature", "humidity_10_13": "relative_humidity_2m", "wind_10_13": "wind_speed_10m"}


def in_window(hourly: DataFrame) -> DataFrame:
    """Observations of the service hours, both ends included."""
    return hourly.filter(F.hour("time").between(*OBSERVATION_HOURS))


def in_site_time(hourly: DataFrame, locations: DataFrame) -> DataFrame:
    """Hourly weather whose times are UTC, by the wall clock of each location (``id``, ``timezone``); others take the default zone.

    A day on which clocks change has 23 or 25 hours; the hour that comes twice is two rows of one time.
    """
    zones = locations.select(F.col("id").alias("location_id"), F.col("timezone").alias("__zone")).distinct()
    utc = F.col("time").cast("timestamp_ntz").cast("timestamp")
    joined = hourly.join(zones, "location_id", "left")
    return joined.withColumn("time", F.from_utc_timestamp(utc, F.coalesce("__zone", F.lit(DEFAULT_TIMEZONE))).cast("timestamp_ntz")).drop("__zone")


def measures() -> list:
    """Aggregates of a day: means of four measures, the sum of precipitation (0 if it has none)."""
    return [*(F.avg(c).alias(name) for name, c in MEANS.items()), F.coalesce(F.sum("precipitation"), F.lit(0.0)).alias("precip_10_13")]


def daily(hourly: DataFrame) -> DataFrame:
    """One row for each location and day that has an observation in the window; filtered before the shuffle."""
    return in_window(hourly).groupBy("location_id", F.to_date("time").alias("date")).agg(*measures())


def join_attendance(attendance: DataFrame, weather: DataFrame) -> DataFrame:
    """Attendance with its day's weather, nulls where there is none. Weather has one row for each key."""
    return attendance.join(weather.withColumnRenamed("date", "service_date"), ["location_id", "service_date"], "left")


def for_targets(targets: DataFrame, forecast: DataFrame, history: DataFrame) -> DataFrame:
    """Weather of the targets: the forecast; else the location's medians, with no precipitation; else 0.

    Where a forecast row is there, only its missing values are filled, by medians.
    """
    columns = list(WEATHER_FEATURES)
    medians = history.groupBy("location_id").agg(*(F.median(c).alias(f"__{c}") for c in columns))
    known = forecast.withColumnRenamed("date", "service_date").withColumn("__known", F.lit(True))
    joined = targets.join(known, ["location_id", "service_date"], "left").join(medians, "location_id", "left")
    filled = {c: F.coalesce(c, F.when(F.col("__known").isNull(), F.lit(0.0)) if c == "precip_10_13" else F.col(f"__{c}"), F.col(f"__{c}"), F.lit(0.0)) for c in columns}
    return joined.withColumns(filled).drop("__known", *(f"__{c}" for c in columns))
