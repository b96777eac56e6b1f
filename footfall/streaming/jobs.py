"""Change feeds as Structured Streaming jobs; each shares its transform with the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from footfall.operators import attendance, logs
from footfall.operators.weather import in_window, measures
from footfall.sources import bucketed


def merge_attendance(current: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The table after a batch of changes: the newest change of each key, and never an older one than the table has."""
    rows = batch if current is None else current.select(*batch.columns).unionByName(batch)
    body = F.struct(*[c for c in batch.columns if c not in attendance.KEY])
    newest = rows.groupBy(*attendance.KEY).agg(F.max_by(body, F.struct("updated_at", "visitors")).alias("__row"))
    return newest.select(*attendance.KEY, "__row.*").select(*batch.columns)


def merge_logs(current: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The logs after a batch of predictions, one of each key; what they replace keeps its first actual.

    A log may come again, with an actual that is newer than the one filled in before: of its two forms the batch's counts.
    """
    if current is None:
        return logs.latest(batch)
    rows = current.select(*batch.columns, F.lit(0).alias("__again")).unionByName(batch.withColumn("__again", F.lit(1)))
    return logs.latest(rows, "__again").drop("__again")


def _merging(merge, root: str):
    """A foreachBatch function: only touched buckets are rewritten, and a batch that is run again after a failure is known by its number."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        bucketed.merge(batch, root, "location_id", merge, str(batch_id))

    return apply


def attendance_feed(changes: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    """Changes (location_id, service_date, visitors, updated_at) into the current table under ``root``.

    A batch's changes are brought to the newest of each key before they are dealt by location, as a batch has more changes than keys.
    """
    merge = _merging(merge_attendance, root)
    return changes.writeStream.foreachBatch(lambda batch, batch_id: merge(merge_attendance(None, batch), batch_id)).option("checkpointLocation", checkpoint)


#: How long a key's state stays after the newest service date seen.
KEPT_FOR = "3650 days"


def current_logs(predictions: DataFrame, late: str = KEPT_FOR) -> DataFrame:
    """One log for each (location_id, service_date) from a stream of predictions, as state that is kept for each key.

    The state is the newest log and the newest known actual with its place in the order; a key that got new logs is given out once a
    batch, as ``logs.latest`` reads it. A key's state goes when its service date is ``late`` behind the newest date seen; logs of such
    dates that come after that are dropped, as the watermark says, and counted by ``rows_too_late``.
    """
    dated = predictions.withColumn("service_date", F.col("service_date").cast("timestamp")).withWatermark("service_date", late)
    return logs.latest(dated).withColumn("service_date", F.col("service_date").cast("date"))


def log_feed(predictions: DataFrame, root: str, checkpoint: str, late: str = KEPT_FOR) -> DataStreamWriter:
    """Prediction logs into the table of one log for each key under ``root``.

    What the state gives out is merged by key, so the table keeps the logs whose state has gone.
    """
    return current_logs(predictions, late).writeStream.outputMode("update").foreachBatch(_merging(merge_logs, root)).option("checkpointLocation", checkpoint)


def matched_actuals(predictions: DataFrame, actuals: DataFrame, late: str = "14 days") -> DataFrame:
    """Predictions with the actual that arrives within ``late`` of them, or without one when the watermark has passed.

    predictions: location_id, service_date, predicted_at, predicted_visitors; actuals: location_id, service_date, arrived_at, visitors.
    """
    left = predictions.withWatermark("predicted_at", late).alias("p")
    right = actuals.withWatermark("arrived_at", late).alias("a")
    near = (F.col("a.arrived_at") >= F.col("p.predicted_at")) & (F.col("a.arrived_at") <= F.col("p.predicted_at") + F.expr(f"interval {late}"))
    same = (F.col("p.location_id") == F.col("a.location_id")) & (F.col("p.service_date") == F.col("a.service_date")) & near
    return left.join(right, same, "left_outer").select("p.location_id", "p.service_date", "p.predicted_at", "p.predicted_visitors", F.col("a.visitors").alias("actual_visitors"))


def rows_too_late(query: StreamingQuery) -> int:
    """Rows that a query's stateful operators dropped because the watermark had passed them, in the batches that it still reports."""
    return sum(o.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for o in p["stateOperators"])


def daily_weather(hourly: DataFrame, late: str | None = "1 day") -> DataFrame:
    """Daily weather of the service window from an hourly stream; a day is complete when the watermark has passed it.

    What comes after that is dropped. Without ``late`` no hour is too late, as a feed in no order of time needs it; a row of state stays for each location and day.
    """
    rows = in_window(hourly)
    days = (rows if late is None else rows.withWatermark("time", late)).groupBy("location_id", F.window("time", "1 day")).agg(*measures())
    return days.select("location_id", F.to_date("window.start").alias("date"), "temp_10_13", "apparent_temp_10_13", "humidity_10_13", "wind_10_13", "precip_10_13")
