"""Prediction logs: one row for each (location_id, service_date), matched with actuals and summarised."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.config import BASELINE_MEALS
from footfall.functions.values import absolute_error, co2e_avoided, waste_avoided

KEY = ["location_id", "service_date"]
#: Columns of a log that a prediction brings; the others are kept from the log it replaces.
PREDICTED = (
    "prediction_created_at", "predicted_visitors", "predicted_quantile", "residual_buffer", "suggested_meals", "meal_buffer_pct",
    "model_segment", "baseline_meals_prepared", "waste_avoided_meals", "estimated_co2e_reduction_kg", "created_by", "source_app",
)


def _newest(logs: DataFrame, *ties: str) -> DataFrame:
    """The newest row of each key in full, with __first, the newest actual there is, and __n, how many rows the key has.

    Aggregates instead of a window: a key predicted many times is combined before the shuffle. ``ties`` order rows that are one log.
    """
    row = F.struct(*[c for c in logs.columns if c not in KEY])
    order = F.struct("prediction_created_at", "id", *ties)
    known = F.when(F.col("actual_visitors").isNotNull(), order)
    newest = logs.groupBy(*KEY).agg(F.max_by(row, order).alias("__row"), F.max_by("actual_visitors", known).alias("__first"), F.count(F.lit(1)).alias("__n"))
    return newest.select(*KEY, "__row.*", "__first", "__n").select(*logs.columns, "__first", "__n")


def dedupe(logs: DataFrame) -> DataFrame:
    """Newest row of each key with the newest known actual; its error is computed anew if an actual is known."""
    out = _newest(logs)
    error = F.when(F.col("__first").isNotNull(), absolute_error(F.col("__first"), F.col("predicted_visitors"))).otherwise(F.col("absolute_error"))
    # a key that has only one row is left as it is stored
    return out.withColumns({"absolute_error": F.when(F.col("__n") > 1, error).otherwise(F.col("absolute_error")), "actual_visitors": F.coalesce("__first", "actual_visitors")}).drop("__first", "__n")


def latest(logs: DataFrame, *ties: str) -> DataFrame:
    """Newest row of each key as it is read: only if it has no actual, the newest known one and its error are filled in."""
    out, lacks = _newest(logs, *ties), F.col("actual_visitors").isNull()
    filled = {"absolute_error": F.when(lacks, absolute_error(F.col("__first"), F.col("predicted_visitors"))).otherwise(F.col("absolute_error")), "actual_visitors": F.coalesce("actual_visitors", "__first")}
    return out.withColumns(filled).drop("__first", "__n")


def newest_first(logs: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` newest logs, a feature of the report."""
    return logs.orderBy(F.desc("service_date"), F.desc("prediction_created_at"), F.desc("location_id"), F.desc("id")).limit(limit)


def match_actuals(logs: DataFrame, attendance: DataFrame) -> DataFrame:
    """Newest log of each key; where there is an actual, with it, its error and the savings computed anew.

    ``matched`` counts the logs of the key that got an actual, duplicates included.
    """
    found = _newest(logs).drop("__first").join(attendance.select(*KEY, F.col("visitors").alias("__actual")), KEY, "left")
    hit, meals = F.col("__actual").isNotNull(), F.col("suggested_meals")
    new = {
        "actual_visitors": F.coalesce("__actual", "actual_visitors"),
        "absolute_error": F.when(hit, absolute_error(F.col("__actual"), F.col("predicted_visitors"))).otherwise(F.col("absolute_error")),
        "waste_avoided_meals": F.when(hit, waste_avoided(meals)).otherwise(F.col("waste_avoided_meals")),
        "estimated_co2e_reduction_kg": F.when(hit, co2e_avoided(meals)).otherwise(F.col("estimated_co2e_reduction_kg")),
        "matched": F.when(hit, F.col("__n")).otherwise(0),
    }
    return found.withColumns(new).drop("__actual", "__n")


def stale(logs: DataFrame, attendance: DataFrame) -> DataFrame:
    """Logs whose day has no attendance; those without a key too."""
    return logs.join(attendance.select(*KEY), KEY, "left_anti")


def kept(logs: DataFrame, attendance: DataFrame) -> DataFrame:
    """Logs whose day has attendance."""
    return logs.join(attendance.select(*KEY), KEY, "left_semi")


def upsert(logs: DataFrame, new: DataFrame) -> DataFrame:
    """The logs after new predictions, one for each key.

    A key that is there keeps the id and the time of creation of its newest log and the newest
    known actual, whose error is computed against the new prediction; all else is new.
    """
    old = _newest(logs).select(*KEY, F.col("id").alias("__id"), F.col("created_at").alias("__created"), F.col("__first"), F.lit(True).alias("__old"))
    merged = new.join(old, KEY, "left").withColumns(
        {
            "id": F.coalesce("__id", "id"),
            "created_at": F.coalesce("__created", "created_at"),
            "actual_visitors": F.col("__first"),
            "absolute_error": absolute_error(F.col("__first"), F.col("predicted_visitors")),
        }
    )
    untouched = logs.join(new.select(*KEY), KEY, "left_anti")
    return untouched.unionByName(merged.select(*logs.columns))


def rows_of(predictions: DataFrame, at: str, created_by: str | None = None, source_app: str | None = None) -> DataFrame:
    """Log rows of predictions made at one time: no actual, no error, savings from the meals."""
    now, meals = F.lit(at).cast("timestamp"), F.col("suggested_meals")
    return predictions.withColumns(
        {
            "prediction_created_at": now,
            "actual_visitors": F.lit(None).cast("int"),
            "absolute_error": F.lit(None).cast("double"),
            "baseline_meals_prepared": F.coalesce("baseline_meals_prepared", F.lit(BASELINE_MEALS)) if "baseline_meals_prepared" in predictions.columns else F.lit(BASELINE_MEALS),
            "waste_avoided_meals": waste_avoided(meals),
            "estimated_co2e_reduction_kg": co2e_avoided(meals),
            "created_by": F.lit(created_by).cast("string"),
            "source_app": F.lit(source_app).cast("string"),
            "created_at": now,
            "updated_at": now,
        }
    )


def _summary() -> list:
    return [
        F.avg(F.when(F.col("actual_visitors").isNotNull(), F.col("absolute_error"))).alias("live_mae"),
        F.count("actual_visitors").alias("logs_with_actuals"),
        F.coalesce(F.sum("waste_avoided_meals"), F.lit(0.0)).alias("total_waste_avoided"),
        F.coalesce(F.sum("estimated_co2e_reduction_kg"), F.lit(0.0)).alias("total_co2e_reduction"),
    ]


def monitoring_summary(logs: DataFrame, newest: int | None = 1000) -> DataFrame:
    """By location: error of matched logs, their number, and the savings of all; of the ``newest`` logs only, or of all."""
    rows = latest(logs)
    if newest is not None:
        line = Window.partitionBy("location_id").orderBy(F.desc("service_date"), F.desc("prediction_created_at"), F.desc("id"))
        rows = rows.withColumn("__n", F.row_number().over(line)).filter(F.col("__n") <= newest)
    return rows.groupBy("location_id").agg(*_summary())


def monitoring_rollup(logs: DataFrame) -> DataFrame:
    """The same over all logs, by location and (null) for all locations."""
    return latest(logs).rollup("location_id").agg(*_summary())


def report(logs: DataFrame) -> DataFrame:
    """What a monitoring page shows: chosen columns, numbers with two places."""
    two = [F.round(c, 2).alias(c) for c in ("predicted_visitors", "predicted_quantile", "residual_buffer", "absolute_error", "waste_avoided_meals", "estimated_co2e_reduction_kg")]
    return logs.select("location_id", "service_date", "suggested_meals", "model_segment", "actual_visitors", *two)


def api_response(predictions: DataFrame) -> DataFrame:
    """A forecast as it is answered: the date as text, numbers with two places."""
    two = [F.round(c, 2).alias(c) for c in ("predicted_visitors", "predicted_quantile", "residual_buffer")]
    return predictions.select("location_id", F.date_format("service_date", "yyyy-MM-dd").alias("service_date"), *two, "suggested_meals", "meal_buffer_pct", "model_segment")
