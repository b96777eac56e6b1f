"""Lag and rolling features, imputation and training frames.

All windows are by location, so one shuffle by location serves them all; frames end before the
current row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.config import feature_names
from footfall.functions.calendar import with_calendar
from footfall.operators.prefix import with_running_quantiles
from footfall.operators.weather import join_attendance

LONGEST_LAG = 3


def _of_last_three(line, function) -> Column:
    """Over the three rows before; null unless all three are there."""
    before = line.rowsBetween(-3, -1)
    return F.when(F.count("visitors").over(before) == 3, function("visitors").over(before))


def with_lags(df: DataFrame) -> DataFrame:
    """Add the lag features to rows with location_id, service_date, visitors, is_sun and slot_num."""
    out = df.repartition("location_id")
    lines = {"": Window.partitionBy("location_id"), "daytype": Window.partitionBy("location_id", "is_sun"), "slot": Window.partitionBy("location_id", "slot_num")}
    for name, keys in lines.items():
        line = keys.orderBy("service_date")
        if name:
            lags, tail = {f"lag_same_{name}_1": F.lag("visitors", 1).over(line)}, f"_{name}_3"
        else:
            lags, tail = {f"lag{k}": F.lag("visitors", k).over(line) for k in range(1, LONGEST_LAG + 1)}, "_3"
        out = out.withColumns(lags | {f"rolling_mean{tail}": _of_last_three(line, F.avg), f"rolling_std{tail}": _of_last_three(line, F.stddev_samp)})
    return out


def impute(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fill nulls with the location's exact median over all its rows; a column without values stays null.

    The windows are unordered and partitioned as the lags are, so they cost no shuffle.
    """
    whole = Window.partitionBy("location_id")
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.median(c).over(whole)) for c in columns})


def impute_from_before(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fill nulls with the median of the location's rows before, so that no row sees what came later; null where none had a value."""
    wanted = {f"__{c}": (c, 0.5) for c in columns}
    known = with_running_quantiles(df.withColumns({c: F.col(c).cast("double") for c in columns}), ["location_id"], "service_date", wanted)
    return known.withColumns({c: F.coalesce(c, f"__{c}") for c in columns}).drop(*wanted)


#: How ``training_frame`` fills gaps: from the whole history, or only from what came before a row.
IMPUTATIONS = {"whole": impute, "prefix": impute_from_before}


def training_frame(attendance: DataFrame, weather: DataFrame | None = None, imputation: str = "whole") -> DataFrame:
    """location_id, service_date, visitors, slot and the features as doubles.

    Locations with fewer than four rows end up empty: their third lag has no median. With ``imputation``
    "prefix" a backtest sees nothing later than its fold; a location's first three rows then have no third lag and go.
    """
    columns = feature_names(weather is not None)
    frame = with_lags(with_calendar(attendance.select("location_id", "service_date", "visitors")))
    if weather is not None:
        frame = join_attendance(frame, weather)
    filled = IMPUTATIONS[imputation](frame, columns)
    finite = filled.withColumns({c: F.when(F.abs(c) < float("inf"), F.col(c)) for c in columns})
    return finite.dropna(subset=["visitors", "lag1", "lag2", "lag3"]).select("location_id", "service_date", "visitors", "slot", *columns)


def target_features(history: DataFrame, targets: DataFrame) -> DataFrame:
    """Calendar and lag features of target dates that lie after all of their location's history (for others see ``target_features_as_of``).

    ``targets`` has one row for each location. Only the last rows that a window can see go into
    the windows: three of each location, day type and slot.
    """
    keys = {"__all": ["location_id"], "__type": ["location_id", "is_sun"], "__slot": ["location_id", "slot_num"]}
    past = with_calendar(history.select("location_id", "service_date", "visitors"))
    for name, key in keys.items():
        past = past.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("service_date"))))
    near = past.filter((F.col("__all") <= 3) | (F.col("__type") <= 3) | (F.col("__slot") <= 3)).select("location_id", "service_date", "visitors", F.lit(False).alias("is_target"))
    last = history.groupBy("location_id").agg(F.max("service_date").alias("__last"))
    future = targets.join(last, "location_id").filter(F.col("service_date") > F.col("__last")).select("location_id", "service_date", F.lit(None).cast("int").alias("visitors"), F.lit(True).alias("is_target"))
    return with_lags(with_calendar(near.unionByName(future))).filter("is_target").drop("is_target")


def target_features_as_of(history: DataFrame, targets: DataFrame) -> DataFrame:
    """Calendar and lag features of any dates, past ones too, from the history strictly before each; any number of targets a location.

    History and targets are merged by date, a day's targets before its history, and each row carries the last
    three values of its location, day type and slot, which targets have none of. Equal targets give equal rows.
    """
    rows = history.select("location_id", "service_date", "visitors", F.lit(1).alias("__past"))
    rows = rows.unionByName(targets.select("location_id", "service_date", F.lit(None).cast("int").alias("visitors"), F.lit(0).alias("__past")))
    out = with_calendar(rows).repartition("location_id")
    for name, keys in {"": "location_id", "daytype": "location_id, is_sun", "slot": "location_id, slot_num"}.items():
        line = f"OVER (PARTITION BY {keys} ORDER BY service_date, __past)"
        out = out.withColumns({f"__{k}": F.expr(f"lag(visitors, {k}) IGNORE NULLS {line}") for k in range(1, LONGEST_LAG + 1)})
        last = [F.col(f"__{k}") for k in range(1, LONGEST_LAG + 1)]
        mean = (last[0] + last[1] + last[2]) / F.lit(3.0)
        spread = F.sqrt(sum((v - mean) * (v - mean) for v in last) / F.lit(2.0))
        tail = f"_{name}_3" if name else "_3"
        lags = {f"lag_same_{name}_1": last[0]} if name else {f"lag{k}": F.col(f"__{k}") for k in range(1, LONGEST_LAG + 1)}
        out = out.withColumns(lags | {f"rolling_mean{tail}": mean, f"rolling_std{tail}": spread}).drop(*(f"__{k}" for k in range(1, LONGEST_LAG + 1)))
    return out.filter("__past = 0").drop("__past")


def fill_targets(targets: DataFrame, history: DataFrame, columns: list[str]) -> DataFrame:
    """Fill what the targets lack with the medians of the location's training frame, else with 0."""
    medians = history.groupBy("location_id").agg(*(F.median(c).alias(f"__{c}") for c in columns))
    filled = targets.join(medians, "location_id", "left").withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"__{c}"), F.lit(0.0)) for c in columns})
    return filled.drop(*(f"__{c}" for c in columns))
