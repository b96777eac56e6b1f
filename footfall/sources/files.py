"""Readers and writers of the domain's files; no reader infers a schema it should know."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall import schemas
from footfall.functions.values import role_of, stripped
from footfall.operators.locations import normalized


def read_attendance_csv(spark: SparkSession, path: str, location_id: str) -> DataFrame:
    """location_id, service_date, visitors from a CSV of service records with a header."""
    rows = spark.read.schema(schemas.SERVICE_RECORDS).option("header", True).csv(path)
    return rows.select(F.lit(location_id).alias("location_id"), "service_date", "visitors")


def read_schedule_grids(spark: SparkSession, path: str) -> DataFrame:
    """Landed schedule sheets (CSV, or Parquet if the path says so); only sheets named by digits."""
    reader = spark.read.schema(schemas.SCHEDULE_GRID)
    grid = reader.parquet(path) if path.rstrip("/").endswith(".parquet") else reader.option("header", True).csv(path)
    return grid.filter(F.col("year").rlike("^[0-9]+$"))


def read_weather_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """The daily weather cache; None if it is empty, which means that there is no weather."""
    rows = spark.read.schema(schemas.WEATHER_DAILY).option("header", True).csv(path)
    return None if rows.isEmpty() else rows


def write_weather_cache(daily: DataFrame, path: str) -> None:
    daily.write.option("header", True).csv(path)


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    """Configured locations from the JSON file, in normal form; a missing key is like a blank value."""
    item = "array<struct<id: string, name: string, zip_code: string, country_code: string, timezone: string>>"
    rows = spark.read.schema(f"locations {item}").option("multiLine", True).json(path)
    return normalized(rows.select(F.inline("locations")))


def write_locations(locations: DataFrame, path: str) -> None:
    """All locations as one JSON object of the form that ``read_locations`` takes: a small configuration."""
    row = F.struct("id", "name", "zip_code", "country_code", "timezone")
    locations.agg(F.to_json(F.struct(F.array_sort(F.collect_list(row)).alias("locations"))).alias("value")).write.text(path)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    """Users from the JSON file, an object with ``users`` or a bare list; of credentials only whether they are there."""
    fields = "username string, role string, authorized_locations array<string>, password_hash string, salt string, iterations string"
    text = spark.read.option("wholetext", True).text(path)
    item = f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in fields.split(', '))}>>"
    bare = F.from_json("value", item)
    inside = F.from_json("value", f"struct<users: {item}>")["users"]
    users = text.select(F.inline(F.when(F.trim("value").startswith("["), bare).otherwise(inside)))

    def there(c: str) -> Column:
        return (F.coalesce(c, F.lit("")) != "").alias(f"has_{c.removeprefix('password_')}")

    named = users.filter(stripped(F.coalesce("username", F.lit(""))) != "")
    return named.select(stripped(F.col("username")).alias("username"), role_of(F.col("role")).alias("role"), "authorized_locations", there("password_hash"), there("salt"), there("iterations"))


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Backtest predictions by location and segment, those of a folder in one file by date; all of a location are the unfiltered read."""
    ordered = predictions.repartition("location_id", "segment").sortWithinPartitions("location_id", "segment", "service_date")
    ordered.write.partitionBy("location_id", "segment").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_metrics`` wrote: location_id, metrics."""
    return spark.read.schema("value string, location_id string").text(path).select("location_id", F.col("value").alias("metrics"))


def write_attendance(attendance: DataFrame, path: str) -> None:
    """A table of attendance by location, each in order of its dates."""
    attendance.repartition("location_id").sortWithinPartitions("location_id", "service_date").write.partitionBy("location_id").parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One JSON document for each location (location_id, metrics)."""
    metrics.select("location_id", F.col("metrics").alias("value")).write.partitionBy("location_id").text(path)


def write_version(df: DataFrame, root: str, partition_by: list[str] | None = None) -> str:
    """Write a table as a new version under ``root`` and note it as the latest; returns the version's path.

    A version that is being read is never written to. The note is a row appended when the version is whole.
    """
    spark = df.sparkSession
    path = f"{root}/data/{uuid.uuid4().hex}"
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
    spark.range(1).select(F.lit(path).alias("path"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return path


def read_version(spark: SparkSession, root: str) -> DataFrame:
    """The latest whole version under ``root``."""
    latest = spark.read.schema("path string, at timestamp").parquet(f"{root}/versions").orderBy(F.desc("at")).first()
    return spark.read.parquet(latest["path"])
