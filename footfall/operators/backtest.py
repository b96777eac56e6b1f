"""Walk-forward folds, error metrics and quantities taken from backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.config import MIN_TRAIN_ROWS, QUANTILE
from footfall.operators.prefix import with_running_quantiles

SCOPES = ("overall", "sat", "sun")
#: Fixed value: what a zero actual is divided by, the spacing of doubles at 1.
EPSILON = 2.220446049250313e-16


def with_segment(frame: DataFrame) -> DataFrame:
    """Sundays are sun, all other days sat."""
    return frame.withColumn("segment", F.when(F.col("is_sun") == 1, "sun").otherwise("sat"))


def folds(frame: DataFrame, min_train_rows: int = MIN_TRAIN_ROWS) -> DataFrame:
    """The rows that are tested: fold i (from 0) of a segment tests its row i, trained on the rows before it."""
    line = Window.partitionBy("location_id", "segment").orderBy("service_date")
    return frame.withColumn("fold", F.row_number().over(line) - 1).filter(F.col("fold") >= min_train_rows).withColumn("train_rows", F.col("fold"))


def expanding_quantile(frame: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """Add pred_q: the linear quantile of all earlier targets of the segment."""
    return with_running_quantiles(frame, ["location_id", "segment"], "service_date", {"pred_q": ("visitors", quantile)})


def naive_backtest(frame: DataFrame, min_train_rows: int = MIN_TRAIN_ROWS, quantile: float = QUANTILE) -> DataFrame:
    """A backtest without a model: the mean of the last three of the day type, and the expanding quantile."""
    rows = folds(expanding_quantile(with_segment(frame), quantile), min_train_rows)
    pred = F.coalesce("rolling_mean_daytype_3", F.col("lag_same_daytype_1").cast("double"), F.col("lag1").cast("double"))
    actual = F.col("visitors").cast("double")
    return rows.select("location_id", "segment", "service_date", "fold", "train_rows", actual.alias("actual"), pred.alias("pred"), "pred_q", F.abs(actual - pred).alias("abs_error"), "is_sun")


def _metrics() -> list:
    error = F.col("pred") - F.col("actual")
    return [
        F.avg(F.abs(error)).alias("MAE"),
        F.sqrt(F.avg(error * error)).alias("RMSE"),
        F.avg(F.abs(error) / F.greatest(F.abs("actual"), F.lit(EPSILON))).alias("MAPE"),
        F.avg(error).alias("Bias"),
        F.percentile("abs_error", F.lit(0.9)).alias("P90AbsError"),
        F.count("pred").alias("BacktestRows"),
    ]


def metrics(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Error metrics of each group, over the rows that have a prediction."""
    return predictions.groupBy(*by).agg(*_metrics())


def metrics_by_scope(predictions: DataFrame, locations: DataFrame) -> DataFrame:
    """Metrics of each location in each scope; a scope without predictions has 0 rows and nulls."""
    grouped = predictions.groupingSets([["location_id"], ["location_id", "segment"]], "location_id", "segment").agg(*_metrics(), F.grouping("segment").alias("__all"))
    named = grouped.withColumn("scope", F.when(F.col("__all") == 1, "overall").otherwise(F.col("segment"))).drop("__all", "segment")
    spine = locations.select("location_id").distinct().withColumn("scope", F.explode(F.lit(list(SCOPES))))
    return spine.join(named, ["location_id", "scope"], "left").withColumn("BacktestRows", F.coalesce("BacktestRows", F.lit(0)))


def metrics_json(scoped: DataFrame) -> DataFrame:
    """location_id and one JSON object of scopes; a scope without rows says only that."""
    values = ["MAE", "RMSE", "MAPE", "Bias", "P90AbsError", "BacktestRows"]
    entry = F.struct("scope", F.struct(*values).alias("values"))
    return scoped.groupBy("location_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("metrics"))


METRICS = "map<string, struct<MAE: double, RMSE: double, MAPE: double, Bias: double, P90AbsError: double, BacktestRows: long>>"


def metrics_of_json(documents: DataFrame) -> DataFrame:
    """``metrics_json`` read back: a row for each location and scope. Text that is no such object gives none."""
    scopes = documents.select("location_id", F.explode(F.from_json("metrics", METRICS)).alias("scope", "values"))
    return scopes.select("location_id", "scope", "values.*")


def residual_buffer(predictions: DataFrame, spine: DataFrame, quantile: float = 0.8) -> DataFrame:
    """By location and segment of ``spine``: the quantile of what was not foreseen, 0 without predictions."""
    short = F.greatest(F.col("actual") - F.col("pred"), F.lit(0.0))
    have = predictions.groupBy("location_id", "segment").agg(F.percentile(short, F.lit(quantile)).alias("residual_buffer"))
    return spine.select("location_id", "segment").join(have, ["location_id", "segment"], "left").withColumn("residual_buffer", F.coalesce("residual_buffer", F.lit(0.0)))
