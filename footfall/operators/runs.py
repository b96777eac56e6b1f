"""Training runs and the decision whom to retrain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.config import MIN_TRAIN_ROWS
from footfall.functions.values import instant_or_null
from footfall.sources import bucketed

#: Fixed value: the reason that unchanged locations are skipped with.
UNCHANGED = "Attendance has not changed since the last successful training run."


#: Fixed value: the error of a location that was to be trained and has neither model nor fold.
NO_FITS = "Backtest has no rows. Reduce min_train_size or provide more data."
#: Columns of a run, whose rows are only ever appended: first as it starts, then as it ends.
RUN = "id long, location_id string, status string, started_at timestamp, finished_at timestamp, attendance_rows long, latest_attendance_updated_at string, metrics string, error_message string, seq int"


def _event(rows: DataFrame, **values: Column) -> DataFrame:
    """Rows of ``RUN``: given values, the columns that ``rows`` has, and nulls."""
    columns = [c.split() for c in RUN.split(", ")]
    return rows.select(*((values[c] if c in values else F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in columns))


def started(planned: DataFrame, state: DataFrame, at: Column) -> DataFrame:
    """The first rows of runs: running for the locations of ``plan`` that are trained, skipped with the reason for the others.

    A run's id comes from its location and start, so a task that runs again writes the same run.
    """
    rows = planned.join(state.select("location_id", "attendance_rows", F.col("latest_updated_at").cast("string").alias("latest_attendance_updated_at")), "location_id", "left")
    status = F.when(F.col("action") == "train", "running").otherwise("skipped")
    return _event(rows, id=F.xxhash64("location_id", at.cast("timestamp")), status=status, started_at=at, error_message=F.col("reason"), seq=F.lit(0))


def finished(begun: DataFrame, results: DataFrame, at: Column, metrics: DataFrame | None = None) -> DataFrame:
    """The last rows of running runs, from the ``results`` (location_id, error_message) of all their fits and folds.

    A run fails with its first error, in the order of texts, and how many there are; also if it has no result at all. ``metrics`` (location_id, metrics) go to runs that succeed.
    """
    seen = results.groupBy("location_id").agg(F.min("error_message").alias("__error"), F.count("error_message").alias("__errors"), F.count(F.lit(1)).alias("__results"))
    rows = begun.filter(F.col("status") == "running").drop("metrics", "error_message").join(seen, "location_id", "left")
    if metrics is not None:
        rows = rows.join(metrics.select("location_id", F.col("metrics").alias("__metrics")), "location_id", "left")
    none, failed = F.col("__results").isNull(), F.coalesce(F.col("__errors") > 0, F.lit(False))
    error = F.when(none, NO_FITS).when(failed, F.concat("__error", F.lit(" ("), F.col("__errors").cast("string"), F.lit(" of "), F.col("__results").cast("string"), F.lit(" fits)")))
    kept = F.when(~none & ~failed, F.col("__metrics")) if metrics is not None else F.lit(None)
    return _event(rows, status=F.when(none | failed, "failed").otherwise("success"), finished_at=at, error_message=error, metrics=kept, seq=F.lit(1))


def record(events: DataFrame, root: str, batch: str | None = None) -> None:
    """Append run rows to the ledger at ``root``; rows that it has, known by id and seq, are not written again."""

    def merged(current: DataFrame | None, new: DataFrame) -> DataFrame:
        new = new.dropDuplicates(["id", "seq"])
        return new if current is None else current.unionByName(new.join(current.select("id", "seq"), ["id", "seq"], "left_anti"))

    bucketed.merge(events, root, "location_id", merged, batch)


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """The state of every run in the ledger at ``root``; none if nothing was recorded."""
    try:
        rows = bucketed.read(spark, root)
    except FileNotFoundError:
        rows = spark.createDataFrame([], RUN)
    return current(rows)


def _first(runs: DataFrame, *order) -> DataFrame:
    line = Window.partitionBy("location_id").orderBy(*order)
    return runs.withColumn("__n", F.row_number().over(line)).filter(F.col("__n") == 1).drop("__n")


def latest(runs: DataFrame) -> DataFrame:
    """Each location's run that started last; runs without a start come last."""
    return _first(runs, F.desc_nulls_last("started_at"), F.desc("id"))


def latest_success(runs: DataFrame) -> DataFrame:
    """Each location's successful run that finished last."""
    return _first(runs.filter(F.col("status") == "success"), F.desc_nulls_last("finished_at"), F.desc_nulls_last("started_at"), F.desc("id"))


def current(run_events: DataFrame) -> DataFrame:
    """The state of each run from the rows appended for it: later rows (by ``seq``) replace earlier ones."""
    body = F.struct(*[c for c in run_events.columns if c != "id"])
    return run_events.groupBy("id").agg(F.max_by(body, "seq").alias("__run")).select("id", "__run.*").drop("seq")


def status_counts(runs: DataFrame) -> DataFrame:
    """How many runs succeeded, were skipped and failed; zeros are shown."""
    return runs.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("success", "skipped", "failed")))


def plan(state: DataFrame, runs: DataFrame, min_train_rows: int = MIN_TRAIN_ROWS, force: bool = False) -> DataFrame:
    """location_id, action (train or skip) and reason.

    Locations with too few rows are skipped whatever else; ``force`` trains unchanged ones.
    ``state`` has attendance_rows and latest_updated_at (text), the runs the text it had then.
    """
    done = latest_success(runs).select("location_id", F.col("latest_attendance_updated_at").alias("__then"), F.lit(True).alias("__done"))
    now, then = F.col("latest_updated_at"), F.col("__then")
    unchanged = F.coalesce(instant_or_null(now) <= instant_or_null(then), F.lit(False)) | F.coalesce((now != "") & (now == then), F.lit(False))
    few = F.format_string(f"Only %d attendance rows; need at least {min_train_rows}.", F.col("attendance_rows"))
    reason = F.when(F.col("attendance_rows") < min_train_rows, few)
    if not force:
        reason = reason.when(F.col("__done") & unchanged, F.lit(UNCHANGED))
    joined = state.join(done, "location_id", "left").withColumn("reason", reason)
    return joined.select("location_id", F.when(F.col("reason").isNull(), "train").otherwise("skip").alias("action"), "reason")
