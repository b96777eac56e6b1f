"""The nightly retraining of all locations as one job, with a ledger of its runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.config import MIN_TRAIN_ROWS, QUANTILE, feature_names
from footfall.operators import attendance, backtest, features, models, runs


def retrain(table: DataFrame, weather: DataFrame | None, ledger_root: str, models_path: str, at: str, min_train_rows: int = MIN_TRAIN_ROWS, quantile: float = QUANTILE, force: bool = False, n_trees: int = 400, rounds: int = 500, refit_every: int = 1) -> DataFrame:
    """Plan, note the runs, fit and backtest those to be trained, write models and folds under ``models_path``, note how each run ended.

    A location whose fits fail ends as failed, with the error, and stops no other. Returns the runs of this night.
    """
    spark, now = table.sparkSession, F.lit(at).cast("timestamp")
    state = attendance.state(table).withColumn("latest_updated_at", F.col("latest_updated_at").cast("string"))
    plan = runs.plan(state, runs.ledger(spark, ledger_root), min_train_rows, force)
    runs.record(runs.started(plan, state, now), ledger_root, f"{at} started")
    tonight = runs.ledger(spark, ledger_root).filter(F.col("started_at") == now)
    rows = table.join(tonight.filter(F.col("status") == "running").select("location_id"), "location_id", "left_semi")
    frame, names = features.training_frame(rows, weather), feature_names(weather is not None)
    models.fit_final(frame, names, quantile, n_trees, rounds).write.mode("overwrite").parquet(f"{models_path}/models")
    models.backtest(frame, names, min_train_rows, quantile, n_trees, rounds, refit_every=refit_every).write.mode("overwrite").parquet(f"{models_path}/folds")
    packs, folds = spark.read.parquet(f"{models_path}/models"), spark.read.parquet(f"{models_path}/folds")
    results = packs.select("location_id", "error_message").unionByName(folds.select("location_id", "error_message"))
    documents = backtest.metrics_json(backtest.metrics_by_scope(folds, packs.select("location_id")))
    runs.record(runs.finished(tonight, results, F.current_timestamp(), documents), ledger_root, f"{at} finished")
    return runs.ledger(spark, ledger_root).filter(F.col("started_at") == now)
