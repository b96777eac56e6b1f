"""Configured locations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.config import DEFAULT_COUNTRY, DEFAULT_TIMEZONE
from footfall.functions.values import safe_location_id, stripped


def normalized(rows: DataFrame) -> DataFrame:
    """Locations as they are saved: fields stripped, defaults for blank ones, none without an id."""
    text = {c: F.nullif(stripped(F.col(c)), F.lit("")) for c in ("id", "name", "zip_code", "country_code", "timezone")}
    out = rows.select(*(e.alias(c) for c, e in text.items())).filter(F.col("id").isNotNull())
    defaults = {"name": F.col("id"), "zip_code": F.lit(""), "country_code": F.lit(DEFAULT_COUNTRY), "timezone": F.lit(DEFAULT_TIMEZONE)}
    return out.withColumns({c: F.coalesce(c, d) for c, d in defaults.items()})


def validation(rows: DataFrame) -> DataFrame:
    """id, seq and what is wrong with each row, in the order id, name, zip code, duplicate; null if nothing."""
    blank = {c: F.coalesce(stripped(F.col(c)), F.lit("")) == "" for c in ("id", "name", "zip_code")}
    same = F.count(F.lit(1)).over(Window.partitionBy(stripped(F.col("id"))))
    reason = F.when(blank["id"], "Please enter a location ID.").when(blank["name"], "Please enter a location name.").when(blank["zip_code"], "Please enter a zip code.").when(same > 1, "That location ID already exists.")
    return rows.select("id", "seq", reason.alias("reason"))


def unknown(facts: DataFrame, locations: DataFrame) -> DataFrame:
    """Locations that facts name and the configuration doesn't."""
    return facts.select("location_id").distinct().join(locations.select(F.col("id").alias("location_id")), "location_id", "left_anti")


def safe_ids(rows: DataFrame) -> DataFrame:
    """id, its safe form, and how many ids share that."""
    safe = safe_location_id(F.col("id"))
    return rows.select("id", safe.alias("safe_id"), F.count(F.lit(1)).over(Window.partitionBy(safe)).alias("sharing"))
