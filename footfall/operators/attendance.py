"""Maintenance of attendance tables, keyed by (location_id, service_date), for all locations at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.functions.values import day_of, number_or_null

KEY = ["location_id", "service_date"]


def load(table: DataFrame, location_id: str | None = None) -> DataFrame:
    """location_id, service_date, visitors; what is no number counts as 0."""
    rows = table if location_id is None else table.filter(F.col("location_id") == location_id)
    return rows.select(*KEY, F.coalesce(number_or_null(F.col("visitors")), F.lit(0)).cast("int").alias("visitors"))


def readable(raw: DataFrame) -> DataFrame:
    """Raw rows (with ``seq``, their order) as they can be read: without dates and numbers that can't, and counts below 0 after rounding (half to even)."""
    day, count = day_of(F.col("service_date").cast("string")), F.rint(number_or_null(F.col("visitors")))
    return raw.select("location_id", day.alias("service_date"), count.alias("visitors"), "seq").filter(F.col("service_date").isNotNull() & (F.col("visitors") >= 0))


def normalize(raw: DataFrame) -> DataFrame:
    """``readable`` rows, the last of each key."""
    valid = readable(raw)
    # the last of a key by an aggregate: combined before the shuffle, so that a hot key is no large group
    return valid.groupBy(*KEY).agg(F.max_by("visitors", "seq").cast("int").alias("visitors"))


def in_range(attendance: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Between two dates, both included; without both bounds, all."""
    return attendance if start is None or end is None else attendance.filter(F.col("service_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))


def upsert(existing: DataFrame, changes: DataFrame) -> DataFrame:
    """The table after the changes: a changed key takes the new row."""
    return existing.join(changes.select(*KEY), KEY, "left_anti").unionByName(changes)


def delete(existing: DataFrame, keys: DataFrame) -> DataFrame:
    """The table without the given keys."""
    return existing.join(keys.select(*KEY), KEY, "left_anti")


def replace(existing: DataFrame, incoming: DataFrame, locations: DataFrame) -> DataFrame:
    """Whole locations replaced: of those in ``locations`` (location_id) only the incoming rows are left, maybe none."""
    return existing.join(locations.select("location_id").distinct(), "location_id", "left_anti").unionByName(incoming.join(locations.select("location_id").distinct(), "location_id", "left_semi"))


def removed_keys(existing: DataFrame, incoming: DataFrame, locations: DataFrame) -> DataFrame:
    """Keys that ``replace`` takes away."""
    return existing.join(locations.select("location_id").distinct(), "location_id", "left_semi").select(*KEY).join(incoming.select(*KEY), KEY, "left_anti")


def bootstrap(existing: DataFrame, seed: DataFrame) -> DataFrame:
    """Seed rows for locations that have no row at all."""
    return existing.unionByName(seed.join(existing.select("location_id").distinct(), "location_id", "left_anti"))


def migrate(source: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store with all of the source's rows, and a report: rows found for each location and (null) in all."""
    return upsert(store, source), source.rollup("location_id").agg(F.count(F.lit(1)).alias("found"))


def state(attendance: DataFrame) -> DataFrame:
    """Rows, first and last date and last update of each location."""
    return attendance.groupBy("location_id").agg(
        F.count(F.lit(1)).alias("attendance_rows"), F.min("service_date").alias("first_date"), F.max("service_date").alias("last_date"), F.max("updated_at").alias("latest_updated_at")
    )


def recent(attendance: DataFrame, k: int = 5) -> DataFrame:
    """The last ``k`` rows of each location, with ``recency`` from 1."""
    newest = Window.partitionBy("location_id").orderBy(F.desc("service_date"))
    return attendance.withColumn("recency", F.row_number().over(newest)).filter(F.col("recency") <= k)


def cancel_latest(attendance: DataFrame) -> DataFrame:
    """The table without the last row of each location."""
    return delete(attendance, recent(attendance, 1))
