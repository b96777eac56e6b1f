"""Registered queries of the attendance operators, each with its SQL for DuckDB.

Dates and times are compared as text and doubles to six places, in both engines.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions import calendar as cal
from footfall.functions import values as val
from footfall.operators import access, attendance, backtest, features, locations, logs, models, runs, schedule, weather
from footfall.plans import workloads
from footfall.plans.fixtures import ctes, fixture
from footfall.sources import bucketed


@dataclass
class Query:
    run: Callable[[Callable[[str], DataFrame]], DataFrame]
    sql: str | None = None
    texts: tuple[str, ...] = ()
    doubles: tuple[str, ...] = ()

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = self.run(lambda name: fixture(spark, sf_dir, name))
        out = out.withColumns({c: F.col(c).cast("string") for c in self.texts} | {c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0) for c in self.doubles})
        return out

    def oracle(self) -> str | None:
        shown = [f"CAST({c} AS VARCHAR) AS {c}" for c in self.texts] + [f'round(CAST("{c}" AS DOUBLE), 6) + 0.0 AS "{c}"' for c in self.doubles]
        return self.sql and (f"SELECT * REPLACE ({', '.join(shown)}) FROM ({self.sql})" if shown else self.sql)


DAY = ("service_date",)
STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
W = "WINDOW l AS (PARTITION BY location_id ORDER BY service_date), t AS (PARTITION BY location_id, is_sun ORDER BY service_date), n AS (PARTITION BY location_id, slot_num ORDER BY service_date)"
NTH = "((day(service_date) - 1) // 7 + 1)"
CALENDAR = f"""SELECT *, year(service_date) AS year_num, month(service_date) AS month_num, day(service_date) AS day_num, isodow(service_date) - 1 AS weekday_num, weekofyear(service_date) AS weekofyear,
  CASE WHEN isodow(service_date) >= 6 THEN 1 ELSE 0 END AS is_weekend, sin(2 * pi() * month(service_date) / 12) AS month_sin, cos(2 * pi() * month(service_date) / 12) AS month_cos,
  concat({NTH}, CASE {NTH} WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END, CASE WHEN isodow(service_date) = 6 THEN ' Sat' ELSE ' Sun' END) AS slot, {NTH} AS slot_num, CASE WHEN isodow(service_date) = 7 THEN 1 ELSE 0 END AS is_sun"""


def _rolling(window: str, tail: str) -> str:
    frame = f"OVER (PARTITION BY location_id{window} ORDER BY service_date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(visitors) {frame} = 3 THEN avg(visitors) {frame} END AS rolling_mean{tail}, CASE WHEN count(visitors) {frame} = 3 THEN stddev_samp(visitors) {frame} END AS rolling_std{tail}"


LAGS = f"""SELECT *, lag(visitors, 1) OVER l AS lag1, lag(visitors, 2) OVER l AS lag2, lag(visitors, 3) OVER l AS lag3, {_rolling('', '_3')}, lag(visitors) OVER t AS lag_same_daytype_1, {_rolling(', is_sun', '_daytype_3')},
  lag(visitors) OVER n AS lag_same_slot_1, {_rolling(', slot_num', '_slot_3')}"""
FRAME = f"cal AS ({CALENDAR} FROM (SELECT location_id, service_date, visitors FROM attendance)), lagged AS ({LAGS} FROM cal {W}), joined AS (SELECT l.*, temp_10_13, apparent_temp_10_13, humidity_10_13, wind_10_13, precip_10_13 FROM lagged l LEFT JOIN weather_daily w ON l.location_id = w.location_id AND l.service_date = w.date)"
FEATURES = workloads.FEATURES
IMPUTED = FRAME + ", imputed AS (SELECT location_id, service_date, visitors, slot, " + ", ".join(f"coalesce(CAST({c} AS DOUBLE), median({c}) OVER (PARTITION BY location_id)) AS {c}" for c in FEATURES) + " FROM joined)"
PLAIN = f"cal AS ({CALENDAR} FROM (SELECT location_id, service_date, visitors FROM attendance)), lagged AS ({LAGS} FROM cal {W})"
NAIVE = PLAIN + """, seg AS (SELECT *, CASE WHEN is_sun = 1 THEN 'sun' ELSE 'sat' END AS segment FROM lagged),
 num AS (SELECT *, row_number() OVER (PARTITION BY location_id, segment ORDER BY service_date) - 1 AS fold, quantile_cont(visitors, 0.8) OVER (PARTITION BY location_id, segment ORDER BY service_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pred_q FROM seg),
 naive AS (SELECT location_id, segment, service_date, CAST(fold AS INT) AS fold, CAST(fold AS INT) AS train_rows, CAST(visitors AS DOUBLE) AS actual, coalesce(rolling_mean_daytype_3, lag_same_daytype_1, lag1) AS pred, pred_q, abs(visitors - coalesce(rolling_mean_daytype_3, lag_same_daytype_1, lag1)) AS abs_error, is_sun FROM num WHERE fold >= 18)"""
METRICS = "avg(abs(pred - actual)) AS MAE, sqrt(avg((pred - actual) * (pred - actual))) AS RMSE, avg(abs(pred - actual) / greatest(abs(actual), 2.220446049250313e-16)) AS MAPE, avg(pred - actual) AS Bias, quantile_cont(abs_error, 0.9) AS P90AbsError, count(*) AS BacktestRows"
METRIC_COLUMNS = ("MAE", "RMSE", "MAPE", "Bias", "P90AbsError")
LATEST = "newest AS (SELECT *, row_number() OVER k AS n, count(*) OVER (PARTITION BY location_id, service_date) AS many, first(actual_visitors IGNORE NULLS) OVER (PARTITION BY location_id, service_date ORDER BY prediction_created_at DESC, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f FROM prediction_logs WINDOW k AS (PARTITION BY location_id, service_date ORDER BY prediction_created_at DESC, id DESC))"
READ = LATEST + ", latest AS (SELECT * EXCLUDE (n, many, f) REPLACE (coalesce(actual_visitors, f) AS actual_visitors, CASE WHEN actual_visitors IS NULL THEN abs(f - predicted_visitors) ELSE absolute_error END AS absolute_error) FROM newest WHERE n = 1)"
LOG_TEXTS = ("service_date", "prediction_created_at", "created_at", "updated_at")
LOG_DOUBLES = ("predicted_visitors", "predicted_quantile", "residual_buffer", "meal_buffer_pct", "absolute_error", "waste_avoided_meals", "estimated_co2e_reduction_kg")
SUMMARY = "avg(CASE WHEN actual_visitors IS NOT NULL THEN absolute_error END) AS live_mae, count(actual_visitors) AS logs_with_actuals, coalesce(sum(waste_avoided_meals), 0) AS total_waste_avoided, coalesce(sum(estimated_co2e_reduction_kg), 0) AS total_co2e_reduction"
SUMMARY_DOUBLES = ("live_mae", "total_waste_avoided", "total_co2e_reduction")
ROLE = f"CASE WHEN lower({STRIP.format('role')}) IN ('admin', 'master') THEN 'master' ELSE 'staff' END"
USERS = f"named AS (SELECT {STRIP.format('username')} AS username, {ROLE} AS role, CASE WHEN {ROLE} = 'master' THEN ['*'] ELSE list_filter(coalesce(authorized_locations, []), lambda x: trim(x) <> '') END AS authorized_locations, has_hash, has_salt, has_iterations, seq FROM users_raw WHERE {STRIP.format('username')} <> '')"


def _changes(t: Callable[[str], DataFrame]) -> DataFrame:
    """A change set: every fifth day of the table with more visitors, and as many new days after it."""
    old = t("attendance").filter(F.dayofyear("service_date") % 5 == 0)
    new = [F.col("location_id"), (F.col("visitors") + 7).alias("visitors"), F.col("updated_at")]
    return old.select(*new, "service_date").unionByName(old.select(*new, F.date_add("service_date", 7000).alias("service_date"))).select("location_id", "service_date", "visitors", "updated_at")


CHANGES = "changes AS (SELECT location_id, service_date, visitors + 7 AS visitors, updated_at FROM attendance WHERE dayofyear(service_date) % 5 = 0 UNION ALL SELECT location_id, service_date + 7000, visitors + 7, updated_at FROM attendance WHERE dayofyear(service_date) % 5 = 0)"
ATTENDANCE_TEXTS = ("service_date", "updated_at")


def _some_locations(t: Callable[[str], DataFrame]) -> DataFrame:
    return t("attendance").select("location_id").distinct().filter(F.expr("location_id like '%1' or location_id = 'loc_3'"))


SOME = "chosen AS (SELECT DISTINCT location_id FROM attendance WHERE location_id LIKE '%1' OR location_id = 'loc_3')"


def _incoming(t: Callable[[str], DataFrame]) -> DataFrame:
    return _changes(t).filter(F.col("location_id") != "loc_3")


def _targets(t: Callable[[str], DataFrame]) -> DataFrame:
    return attendance.state(t("attendance")).select("location_id", cal.next_service_date(F.col("last_date")).alias("service_date"))


TARGETS = "targets AS (SELECT location_id, CASE isodow(max(service_date)) WHEN 6 THEN max(service_date) + 1 WHEN 7 THEN max(service_date) + 6 ELSE max(service_date) + CAST(6 - isodow(max(service_date)) AS INT) END AS service_date FROM attendance GROUP BY location_id)"
TARGET_FRAME = f"cal AS ({CALENDAR} FROM (SELECT location_id, service_date, visitors, false AS is_target FROM attendance UNION ALL SELECT location_id, service_date, NULL, true FROM targets)), lagged AS ({LAGS} FROM cal {W})"


def _any_targets(t: Callable[[str], DataFrame]) -> DataFrame:
    """Dates of all kinds, past ones and weekdays too, some twice, and each location's next."""
    days = t("weather_daily").select("location_id", F.col("date").alias("service_date"))
    return days.filter(F.dayofmonth("service_date") % 10 == 3).unionByName(days.filter(F.dayofmonth("service_date") == 13)).unionByName(_targets(t))


ANY_TARGETS = "anyday AS (SELECT location_id, date AS service_date FROM weather_daily WHERE day(date) % 10 = 3 UNION ALL SELECT location_id, date FROM weather_daily WHERE day(date) = 13 UNION ALL SELECT * FROM targets)"


def _before(name: str, same: str) -> str:
    """The last three values before each wanted day, of the rows that agree in ``same``."""
    return f"""{name} AS (SELECT location_id, service_date, max(CASE WHEN n = 1 THEN visitors END) AS v1, max(CASE WHEN n = 2 THEN visitors END) AS v2, max(CASE WHEN n = 3 THEN visitors END) AS v3,
      CASE WHEN count(*) = 3 THEN avg(visitors) END AS mean, CASE WHEN count(*) = 3 THEN stddev_samp(visitors) END AS std
      FROM (SELECT w.location_id, w.service_date, h.visitors, row_number() OVER (PARTITION BY w.location_id, w.service_date ORDER BY h.service_date DESC) AS n FROM (SELECT DISTINCT * FROM wanted) w JOIN past h ON h.location_id = w.location_id AND h.service_date < w.service_date{same}) WHERE n <= 3 GROUP BY 1, 2)"""


AS_OF = f"""past AS ({CALENDAR} FROM (SELECT location_id, service_date, visitors FROM attendance)), wanted AS ({CALENDAR} FROM anyday), {_before('b', '')}, {_before('d', ' AND h.is_sun = w.is_sun')}, {_before('s', ' AND h.slot_num = w.slot_num')}"""
AS_OF_COLUMNS = "b.v1 AS lag1, b.v2 AS lag2, b.v3 AS lag3, b.mean AS rolling_mean_3, b.std AS rolling_std_3, d.v1 AS lag_same_daytype_1, d.mean AS rolling_mean_daytype_3, d.std AS rolling_std_daytype_3, s.v1 AS lag_same_slot_1, s.mean AS rolling_mean_slot_3, s.std AS rolling_std_slot_3"
ROLLING = tuple(f"rolling_{k}{s}_3" for k in ("mean", "std") for s in ("", "_daytype", "_slot"))


def _packs(t: Callable[[str], DataFrame]) -> DataFrame:
    """Stand-ins for models: of the segments that have over 140 rows."""
    sizes = backtest.with_segment(cal.with_calendar(t("attendance"))).groupBy("location_id", "segment").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("location_id", "segment", F.when(F.col("n") > 140, F.lit("model").cast("binary")).alias("point_model"))


PREFIX = FRAME + ", imputed AS (SELECT location_id, service_date, visitors, slot, " + ", ".join(f"coalesce(CAST({c} AS DOUBLE), median({c}) OVER (PARTITION BY location_id ORDER BY service_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS {c}" for c in FEATURES) + " FROM joined)"
STATE = """s AS (SELECT location_id, count(*) AS n, concat(substr(CAST(max(updated_at) AS VARCHAR), 1, 10), 'T00:00:00+00:00') AS now FROM attendance GROUP BY 1)"""
RETRAIN = STATE + """,
      r AS (SELECT location_id, latest_attendance_updated_at AS old FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY finished_at DESC NULLS LAST, started_at DESC NULLS LAST, id DESC) AS n FROM training_runs WHERE status = 'success') WHERE n = 1),
      j AS (SELECT s.location_id, n, now, CASE WHEN n < 300 THEN concat('Only ', n, ' attendance rows; need at least 300.') WHEN try_cast(now AS TIMESTAMPTZ) <= try_cast(old AS TIMESTAMPTZ) OR (now <> '' AND now = old) THEN 'Attendance has not changed since the last successful training run.' END AS reason FROM s LEFT JOIN r ON s.location_id = r.location_id)"""


def _state(t: Callable[[str], DataFrame]) -> DataFrame:
    return attendance.state(t("attendance")).withColumn("latest_updated_at", F.concat(F.substring(F.col("latest_updated_at").cast("string"), 1, 10), F.lit("T00:00:00+00:00")))


def _run_ledger(t: Callable[[str], DataFrame]) -> DataFrame:
    """Runs of one night, with the folds of a backtest as results; some folds of the locations that end in 7 fail."""
    state = _state(t)
    begun = runs.started(runs.plan(state, t("training_runs"), 300), state, F.lit("2024-01-06 02:00:00"))
    folds = backtest.naive_backtest(features.with_lags(cal.with_calendar(t("attendance"))))
    results = folds.select("location_id", F.when(F.col("location_id").like("%7") & (F.col("fold") % 10 == 0), F.concat(F.lit("fold "), F.col("fold").cast("string"))).alias("error_message"))
    ended = runs.finished(begun, results, F.lit("2024-01-06 03:00:00"))
    return runs.current(begun.unionByName(ended)).drop("id", "metrics")


def _bucketed(t: Callable[[str], DataFrame]) -> DataFrame:
    """The table in buckets, after a change set and the replacement of some locations."""
    spark = t("attendance").sparkSession
    root = f"{workloads.shared_folder(spark)}/table"

    def changed(current: DataFrame | None, changes: DataFrame) -> DataFrame:
        return changes if current is None else attendance.upsert(current, changes)

    chosen = _some_locations(t)
    incoming = _incoming(t).join(chosen, "location_id", "left_semi")
    bucketed.merge(t("attendance"), root, "location_id", changed)
    bucketed.merge(_changes(t), root, "location_id", changed)
    bucketed.merge(incoming, root, "location_id", lambda current, new: attendance.replace(current, new, chosen), touched=chosen)
    return bucketed.read(spark, root)


def _site_weather(t: Callable[[str], DataFrame]) -> DataFrame:
    """Hourly weather as UTC, in the spring and the autumn in which clocks change, to days of the sites' own time."""
    utc = t("weather_hourly")
    both = [utc.withColumn("time", F.col("time") + F.make_dt_interval(F.lit(d))) for d in (65, 290)]
    zone = F.when(F.col("id").isin("loc_1", "loc_3"), "Europe/Berlin").when(F.col("id") == "loc_2", "Asia/Tokyo")
    return weather.daily(weather.in_site_time(both[0].unionByName(both[1]), t("locations").select("id", zone.alias("timezone"))))


SITE_WEATHER = """hours AS (SELECT * REPLACE (time + INTERVAL 65 DAY AS time) FROM weather_hourly UNION ALL SELECT * REPLACE (time + INTERVAL 290 DAY AS time) FROM weather_hourly),
  own AS (SELECT * REPLACE ((time AT TIME ZONE 'UTC') AT TIME ZONE CASE WHEN location_id IN ('loc_1', 'loc_3') THEN 'Europe/Berlin' WHEN location_id = 'loc_2' THEN 'Asia/Tokyo' ELSE 'America/New_York' END AS time) FROM hours)"""


def _meals(logs_: DataFrame) -> Column:
    return val.suggested_meals(F.col("predicted_visitors"), F.when(F.col("id") % 4 > 0, F.col("predicted_quantile")), F.col("residual_buffer"), F.when(F.col("id") % 3 > 0, F.col("meal_buffer_pct") * 2))


def _new_predictions(t: Callable[[str], DataFrame]) -> DataFrame:
    """New logs for every third key, and for a week that has none."""
    one = logs.latest(t("prediction_logs")).filter(F.col("id") % 3 == 0).withColumns({"predicted_visitors": F.col("predicted_visitors") + 10, "id": F.col("id") + 100000000, "actual_visitors": F.lit(None).cast("int"), "absolute_error": F.lit(None).cast("double"), "created_at": F.col("prediction_created_at")})
    return one.unionByName(one.withColumns({"service_date": F.date_add("service_date", 7000), "id": F.col("id") + 100000000}))


NEW_LOGS = READ + """, one AS (SELECT * REPLACE (predicted_visitors + 10 AS predicted_visitors, id + 100000000 AS id, CAST(NULL AS INT) AS actual_visitors, CAST(NULL AS DOUBLE) AS absolute_error, prediction_created_at AS created_at) FROM latest WHERE id % 3 = 0),
 fresh AS (SELECT * FROM one UNION ALL SELECT * REPLACE (service_date + 7000 AS service_date, id + 100000000 AS id) FROM one)"""
NORMAL = """SELECT location_id, service_date, CAST(visitors AS INT) AS visitors FROM (SELECT *, row_number() OVER (PARTITION BY location_id, service_date ORDER BY seq DESC) AS n FROM (
  SELECT location_id, try_cast(service_date AS DATE) AS service_date, round_even(try_cast(visitors AS DOUBLE), 0) AS visitors, seq FROM attendance_raw) WHERE service_date IS NOT NULL AND visitors >= 0) WHERE n = 1"""
SLOT_RE = "'^(\\d)(?:st|nd|rd|th)\\s+(Sat|Sun)'"
MONTH_LIST = "['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec']"
GRID = f"""cut AS (SELECT *, min(CASE WHEN lower({STRIP.format('slot')}) = 'totals' THEN row_idx END) OVER (PARTITION BY source_id, year) AS e FROM schedule_grid WHERE regexp_matches(year, '^[0-9]+$')),
 named AS (SELECT *, try_cast(regexp_extract({STRIP.format('slot')}, {SLOT_RE}, 1, 'i') AS INT) AS nth, CASE lower(regexp_extract({STRIP.format('slot')}, {SLOT_RE}, 2, 'i')) WHEN 'sat' THEN 5 WHEN 'sun' THEN 6 END AS wd FROM cut WHERE e IS NULL OR row_idx < e),
 long AS (SELECT source_id, CAST(year AS INT) AS year, row_idx, slot, coalesce(team, '') AS team, nth, wd, list_position({MONTH_LIST}, m) AS month, CAST(trunc(try_cast(cell AS DOUBLE)) AS INT) AS visitors FROM (UNPIVOT (SELECT * FROM named WHERE nth IS NOT NULL) ON Jan, Feb, Mar, Apr, May, Jun, Jul, Aug, Sep, Oct, Nov, Dec INTO NAME m VALUE cell)),
 dated AS (SELECT *, make_date(year, month, 1) + CAST((wd - (isodow(make_date(year, month, 1)) - 1) + 7) % 7 + 7 * (nth - 1) AS INT) AS service_date FROM long WHERE visitors IS NOT NULL),
 records AS (SELECT source_id, service_date, visitors, year, CAST(month AS INT) AS month, slot, team, row_idx FROM dated WHERE nth >= 1 AND month(service_date) = month AND year(service_date) = year)"""


QUERIES: dict[str, Query] = {
    # sources, cleaning
    "attendance_load": Query(lambda t: attendance.load(t("attendance_raw").select("location_id", "service_date", "visitors")), ctes("attendance_raw") + " SELECT location_id, service_date, CAST(coalesce(try_cast(visitors AS DOUBLE), 0) AS INT) AS visitors FROM attendance_raw".replace("CAST(coalesce(", "CAST(trunc(coalesce(").replace(", 0) AS INT)", ", 0)) AS INT)")),
    "locations_normalized": Query(lambda t: locations.normalized(t("locations_raw")), ctes("locations_raw") + f", s AS (SELECT {', '.join(f'nullif({STRIP.format(c)}, chr(0)) AS {c}' for c in ('id', 'name', 'zip_code', 'country_code', 'timezone'))} FROM locations_raw) SELECT id, coalesce(nullif(name, ''), id) AS name, coalesce(zip_code, '') AS zip_code, coalesce(nullif(country_code, ''), 'US') AS country_code, coalesce(nullif(timezone, ''), 'America/New_York') AS timezone FROM s WHERE id <> ''"),
    "migrate_counts": Query(lambda t: attendance.migrate(_changes(t), t("attendance"))[1], ctes("attendance") + f", {CHANGES} SELECT location_id, count(*) AS found FROM changes GROUP BY ROLLUP (location_id)"),
    "attendance_migrate": Query(lambda t: attendance.migrate(_changes(t), t("attendance"))[0], ctes("attendance") + f", {CHANGES} SELECT * FROM changes UNION ALL SELECT * FROM attendance a WHERE NOT EXISTS (SELECT 1 FROM changes c WHERE c.location_id = a.location_id AND c.service_date = a.service_date)", ATTENDANCE_TEXTS),
    "attendance_bootstrap": Query(lambda t: attendance.bootstrap(t("attendance").join(_some_locations(t), "location_id", "left_semi"), _changes(t)), ctes("attendance") + f", {CHANGES}, {SOME} SELECT * FROM attendance WHERE location_id IN (SELECT location_id FROM chosen) UNION ALL SELECT * FROM changes WHERE location_id NOT IN (SELECT location_id FROM chosen)", ATTENDANCE_TEXTS),
    "slot_parse": Query(lambda t: t("schedule_grid").select("source_id", "year", "row_idx", "slot", val.slot_nth(F.col("slot")).alias("nth"), val.slot_weekday(F.col("slot")).alias("weekday")), ctes("schedule_grid") + f" SELECT source_id, year, row_idx, slot, try_cast(regexp_extract({STRIP.format('slot')}, {SLOT_RE}, 1, 'i') AS INT) AS nth, CASE lower(regexp_extract({STRIP.format('slot')}, {SLOT_RE}, 2, 'i')) WHEN 'sat' THEN 5 WHEN 'sun' THEN 6 END AS weekday FROM schedule_grid"),
    "schedule_unpivot": Query(lambda t: schedule.parse_grid(t("schedule_grid")), ctes("schedule_grid") + f", {GRID} SELECT * FROM records", DAY),
    "service_records_clean": Query(lambda t: schedule.clean_records(schedule.parse_grid(t("schedule_grid"))), ctes("schedule_grid") + f", {GRID} SELECT source_id, service_date, visitors, year, month, slot, team FROM (SELECT *, row_number() OVER (PARTITION BY source_id, service_date, slot ORDER BY year DESC, row_idx DESC, month DESC) AS n FROM records) WHERE n = 1 AND visitors > 0", DAY),
    "attendance_normalized": Query(lambda t: attendance.normalize(t("attendance_raw")), ctes("attendance_raw") + " " + NORMAL, DAY),
    "attendance_range": Query(lambda t: attendance.in_range(t("attendance"), "1996-03-02", "1998-11-29"), ctes("attendance") + " SELECT * FROM attendance WHERE service_date BETWEEN DATE '1996-03-02' AND DATE '1998-11-29'", ATTENDANCE_TEXTS),
    "segment_for_date": Query(lambda t: t("weather_daily").select("location_id", F.col("date").alias("service_date"), cal.segment(F.col("date")).alias("segment")), ctes("weather_daily") + " SELECT location_id, date AS service_date, CASE isodow(date) WHEN 6 THEN 'sat' WHEN 7 THEN 'sun' END AS segment FROM weather_daily", DAY),
    "safe_location_id": Query(lambda t: locations.safe_ids(t("users_raw").select(F.col("username").alias("id"))), ctes("users_raw") + f", s AS (SELECT username AS id, regexp_replace(lower({STRIP.format('username')}), '[^\\p{{L}}\\p{{N}}_-]', '_', 'g') AS safe_id FROM users_raw) SELECT id, safe_id, count(*) OVER (PARTITION BY safe_id) AS sharing FROM s"),
    "location_validation": Query(lambda t: locations.validation(t("locations_raw")), ctes("locations_raw") + f" SELECT id, seq, CASE WHEN {STRIP.format('id')} = '' THEN 'Please enter a location ID.' WHEN {STRIP.format('name')} = '' THEN 'Please enter a location name.' WHEN coalesce({STRIP.format('zip_code')}, '') = '' THEN 'Please enter a zip code.' WHEN count(*) OVER (PARTITION BY {STRIP.format('id')}) > 1 THEN 'That location ID already exists.' END AS reason FROM locations_raw"),
    "unknown_locations": Query(lambda t: locations.unknown(t("attendance"), t("locations")), ctes("attendance", "locations") + " SELECT DISTINCT location_id FROM attendance WHERE location_id NOT IN (SELECT id FROM locations)"),
    # attendance maintenance
    "attendance_state": Query(lambda t: attendance.state(t("attendance")), ctes("attendance") + " SELECT location_id, count(*) AS attendance_rows, min(service_date) AS first_date, max(service_date) AS last_date, max(updated_at) AS latest_updated_at FROM attendance GROUP BY 1", ("first_date", "last_date", "latest_updated_at")),
    "attendance_upsert": Query(lambda t: attendance.upsert(t("attendance"), _changes(t)), ctes("attendance") + f", {CHANGES} SELECT * FROM changes UNION ALL SELECT * FROM attendance a WHERE NOT EXISTS (SELECT 1 FROM changes c WHERE c.location_id = a.location_id AND c.service_date = a.service_date)", ATTENDANCE_TEXTS),
    "attendance_delete": Query(lambda t: attendance.delete(t("attendance"), _changes(t)), ctes("attendance") + f", {CHANGES} SELECT * FROM attendance a WHERE NOT EXISTS (SELECT 1 FROM changes c WHERE c.location_id = a.location_id AND c.service_date = a.service_date)", ATTENDANCE_TEXTS),
    "attendance_replace": Query(lambda t: attendance.replace(t("attendance"), _incoming(t), _some_locations(t)), ctes("attendance") + f", {CHANGES}, {SOME} SELECT * FROM attendance WHERE location_id NOT IN (SELECT location_id FROM chosen) UNION ALL SELECT * FROM changes WHERE location_id IN (SELECT location_id FROM chosen) AND location_id <> 'loc_3'", ATTENDANCE_TEXTS),
    "attendance_removed_dates": Query(lambda t: attendance.removed_keys(t("attendance"), _incoming(t), _some_locations(t)), ctes("attendance") + f", {CHANGES}, {SOME} SELECT location_id, service_date FROM attendance WHERE location_id IN (SELECT location_id FROM chosen) EXCEPT SELECT location_id, service_date FROM changes WHERE location_id <> 'loc_3'", DAY),
    "recent_attendance": Query(lambda t: attendance.recent(t("attendance")), ctes("attendance") + " SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY location_id ORDER BY service_date DESC) AS INT) AS recency FROM attendance) WHERE recency <= 5", ATTENDANCE_TEXTS),
    "cancel_latest": Query(lambda t: attendance.cancel_latest(t("attendance")), ctes("attendance") + " SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY service_date DESC) AS n FROM attendance) WHERE n > 1", ATTENDANCE_TEXTS),
    # weather, features
    "weather_daily": Query(lambda t: weather.daily(t("weather_hourly")), ctes("weather_hourly") + " SELECT location_id, CAST(time AS DATE) AS date, avg(temperature_2m) AS temp_10_13, avg(apparent_temperature) AS apparent_temp_10_13, avg(relative_humidity_2m) AS humidity_10_13, avg(wind_speed_10m) AS wind_10_13, coalesce(sum(precipitation), 0) AS precip_10_13 FROM weather_hourly WHERE hour(time) BETWEEN 10 AND 13 GROUP BY 1, 2", ("date",), weather.WEATHER_FEATURES),
    "attendance_weather_join": Query(lambda t: weather.join_attendance(t("attendance"), t("weather_daily")), ctes("attendance", "weather_daily") + " SELECT a.*, temp_10_13, apparent_temp_10_13, humidity_10_13, wind_10_13, precip_10_13 FROM attendance a LEFT JOIN weather_daily w ON a.location_id = w.location_id AND a.service_date = w.date", ATTENDANCE_TEXTS, weather.WEATHER_FEATURES),
    "calendar_features": Query(lambda t: cal.with_calendar(t("weather_daily").select("location_id", F.col("date").alias("service_date"))), ctes("weather_daily") + f" {CALENDAR} FROM (SELECT location_id, date AS service_date FROM weather_daily)", DAY, ("month_sin", "month_cos")),
    "nth_weekday": Query(lambda t: t("attendance").select("location_id", "service_date", *(cal.nth_weekday(F.year("service_date"), F.month("service_date"), F.weekday("service_date"), F.dayofmonth("service_date") % 7).alias(c) for c in ("hit",))), ctes("attendance") + ", f AS (SELECT *, CAST(date_trunc('month', service_date) AS DATE) AS first, day(service_date) % 7 AS n FROM attendance), d AS (SELECT *, first + CAST((isodow(service_date) - isodow(first) + 7) % 7 + 7 * (n - 1) AS INT) AS hit FROM f) SELECT location_id, service_date, CASE WHEN n >= 1 AND month(hit) = month(service_date) THEN hit END AS hit FROM d", ("service_date", "hit")),
    "next_service_date": Query(lambda t: t("weather_daily").select("location_id", "date", cal.next_service_date(F.col("date")).alias("following")), ctes("weather_daily") + " SELECT location_id, date, CASE isodow(date) WHEN 6 THEN date + 1 WHEN 7 THEN date + 6 ELSE date + CAST(6 - isodow(date) AS INT) END AS following FROM weather_daily", ("date", "following")),
    "lag_features": Query(lambda t: features.with_lags(cal.with_calendar(t("attendance"))).select("location_id", "service_date", "lag1", "lag2", "lag3"), ctes("attendance") + f", {PLAIN} SELECT location_id, service_date, lag1, lag2, lag3 FROM lagged", DAY),
    "rolling_features": Query(lambda t: features.with_lags(cal.with_calendar(t("attendance"))).select("location_id", "service_date", "rolling_mean_3", "rolling_std_3"), ctes("attendance") + f", {PLAIN} SELECT location_id, service_date, rolling_mean_3, rolling_std_3 FROM lagged", DAY, ("rolling_mean_3", "rolling_std_3")),
    "daytype_features": Query(lambda t: features.with_lags(cal.with_calendar(t("attendance"))).select("location_id", "service_date", "lag_same_daytype_1", "rolling_mean_daytype_3", "rolling_std_daytype_3"), ctes("attendance") + f", {PLAIN} SELECT location_id, service_date, lag_same_daytype_1, rolling_mean_daytype_3, rolling_std_daytype_3 FROM lagged", DAY, ("rolling_mean_daytype_3", "rolling_std_daytype_3")),
    "slot_features": Query(lambda t: features.with_lags(cal.with_calendar(t("attendance"))).select("location_id", "service_date", "lag_same_slot_1", "rolling_mean_slot_3", "rolling_std_slot_3"), ctes("attendance") + f", {PLAIN} SELECT location_id, service_date, lag_same_slot_1, rolling_mean_slot_3, rolling_std_slot_3 FROM lagged", DAY, ("rolling_mean_slot_3", "rolling_std_slot_3")),
    "features_imputed": Query(lambda t: features.impute(weather.join_attendance(features.with_lags(cal.with_calendar(t("attendance").select("location_id", "service_date", "visitors"))), t("weather_daily")), FEATURES).select("location_id", "service_date", "visitors", "slot", *FEATURES), ctes("attendance", "weather_daily") + f", {IMPUTED} SELECT * FROM imputed", DAY, tuple(FEATURES)),
    "training_frame": Query(lambda t: features.training_frame(t("attendance"), t("weather_daily")), ctes("attendance", "weather_daily") + f", {IMPUTED} SELECT * FROM imputed WHERE visitors IS NOT NULL AND lag1 IS NOT NULL AND lag2 IS NOT NULL AND lag3 IS NOT NULL", DAY, tuple(FEATURES)),
    "target_features": Query(lambda t: features.target_features(t("attendance"), _targets(t)), ctes("attendance") + f", {TARGETS}, {TARGET_FRAME} SELECT * EXCLUDE is_target FROM lagged WHERE is_target", DAY, ("month_sin", "month_cos", *(f"rolling_{k}{s}_3" for k in ("mean", "std") for s in ("", "_daytype", "_slot")))),
    "target_weather_fallback": Query(lambda t: weather.for_targets(_targets(t).unionByName(t("attendance").select("location_id", "service_date")), t("weather_daily").filter(F.dayofmonth("date") % 2 == 0), t("weather_daily")), ctes("attendance", "weather_daily") + f", {TARGETS}, m AS (SELECT location_id, {', '.join(f'median({c}) AS {c}' for c in weather.WEATHER_FEATURES)} FROM weather_daily GROUP BY 1), w AS (SELECT * FROM weather_daily WHERE day(date) % 2 = 0), x AS (SELECT * FROM targets UNION ALL SELECT location_id, service_date FROM attendance) SELECT x.location_id, x.service_date, {', '.join(f'coalesce(w.{c}, m.{c}, 0) AS {c}' for c in weather.WEATHER_FEATURES[:-1])}, coalesce(w.precip_10_13, CASE WHEN w.date IS NULL THEN 0 END, m.precip_10_13, 0) AS precip_10_13 FROM x LEFT JOIN w ON x.location_id = w.location_id AND x.service_date = w.date LEFT JOIN m ON x.location_id = m.location_id", DAY, weather.WEATHER_FEATURES),
    "features_imputed_prefix": Query(
        lambda t: features.training_frame(t("attendance"), t("weather_daily"), "prefix"),
        ctes("attendance", "weather_daily") + f", {PREFIX} SELECT * FROM imputed WHERE visitors IS NOT NULL AND lag1 IS NOT NULL AND lag2 IS NOT NULL AND lag3 IS NOT NULL",
        DAY,
        tuple(FEATURES),
    ),
    "target_features_as_of": Query(
        lambda t: features.target_features_as_of(t("attendance"), _any_targets(t)),
        ctes("attendance", "weather_daily") + f", {TARGETS}, {ANY_TARGETS}, {AS_OF} SELECT w.*, CAST(NULL AS INT) AS visitors, {AS_OF_COLUMNS} FROM wanted w LEFT JOIN b USING (location_id, service_date) LEFT JOIN d USING (location_id, service_date) LEFT JOIN s USING (location_id, service_date)",
        DAY,
        ("month_sin", "month_cos", *ROLLING),
    ),
    "target_verdicts": Query(
        lambda t: models.judged(_any_targets(t), _packs(t)),
        ctes("attendance", "weather_daily")
        + f""", {TARGETS}, {ANY_TARGETS}, p AS (SELECT location_id, CASE WHEN isodow(service_date) = 7 THEN 'sun' ELSE 'sat' END AS segment FROM attendance GROUP BY 1, 2 HAVING count(*) > 140),
          x AS (SELECT *, CASE isodow(service_date) WHEN 6 THEN 'sat' WHEN 7 THEN 'sun' END AS segment FROM anyday)
          SELECT x.location_id, x.segment, service_date, CASE WHEN x.segment IS NULL THEN 'target_date must be Saturday or Sunday' WHEN p.segment IS NULL THEN concat('No trained model for segment: ', x.segment) END AS reason FROM x LEFT JOIN p ON p.location_id = x.location_id AND p.segment = x.segment""",
        DAY,
    ),
    "weather_daily_local": Query(
        _site_weather,
        ctes("weather_hourly")
        + f", {SITE_WEATHER} SELECT location_id, CAST(time AS DATE) AS date, avg(temperature_2m) AS temp_10_13, avg(apparent_temperature) AS apparent_temp_10_13, avg(relative_humidity_2m) AS humidity_10_13, avg(wind_speed_10m) AS wind_10_13, coalesce(sum(precipitation), 0) AS precip_10_13 FROM own WHERE hour(time) BETWEEN 10 AND 13 GROUP BY 1, 2",
        ("date",),
        weather.WEATHER_FEATURES,
    ),
    "attendance_bucketed": Query(
        _bucketed,
        ctes("attendance")
        + f", {CHANGES}, {SOME}, u AS (SELECT * FROM changes UNION ALL SELECT * FROM attendance a WHERE NOT EXISTS (SELECT 1 FROM changes c WHERE c.location_id = a.location_id AND c.service_date = a.service_date)) SELECT * FROM u WHERE location_id NOT IN (SELECT location_id FROM chosen) UNION ALL SELECT * FROM changes WHERE location_id IN (SELECT location_id FROM chosen) AND location_id <> 'loc_3'",
        ATTENDANCE_TEXTS,
    ),
    # backtests
    "metrics_read_back": Query(
        lambda t: backtest.metrics_of_json(backtest.metrics_json(backtest.metrics_by_scope(backtest.naive_backtest(features.with_lags(cal.with_calendar(t("attendance")))), t("locations").select(F.col("id").alias("location_id"))))),
        ctes("attendance", "locations")
        + f", {NAIVE}, m AS (SELECT location_id, coalesce(segment, 'overall') AS scope, {METRICS} FROM naive GROUP BY GROUPING SETS ((location_id), (location_id, segment))) SELECT l.id AS location_id, s.scope, MAE, RMSE, MAPE, Bias, P90AbsError, coalesce(BacktestRows, 0) AS BacktestRows FROM locations l CROSS JOIN (SELECT unnest(['overall', 'sat', 'sun']) AS scope) s LEFT JOIN m ON m.location_id = l.id AND m.scope = s.scope",
        (),
        METRIC_COLUMNS,
    ),
    "backtest_folds": Query(lambda t: backtest.folds(backtest.with_segment(cal.with_calendar(t("attendance")))).select("location_id", "segment", "service_date", "fold", "train_rows"), ctes("attendance") + f", {NAIVE} SELECT location_id, segment, service_date, fold, train_rows FROM naive", DAY),
    "expanding_quantile": Query(lambda t: backtest.expanding_quantile(backtest.with_segment(cal.with_calendar(t("attendance")))).select("location_id", "segment", "service_date", "pred_q"), ctes("attendance") + f", {NAIVE} SELECT location_id, segment, service_date, pred_q FROM num", DAY, ("pred_q",)),
    "naive_backtest": Query(lambda t: backtest.naive_backtest(features.with_lags(cal.with_calendar(t("attendance")))), ctes("attendance") + f", {NAIVE} SELECT * FROM naive", DAY, ("actual", "pred", "pred_q", "abs_error")),
    "backtest_metrics": Query(lambda t: backtest.metrics(backtest.naive_backtest(features.with_lags(cal.with_calendar(t("attendance")))), ["location_id", "segment"]), ctes("attendance") + f", {NAIVE} SELECT location_id, segment, {METRICS} FROM naive GROUP BY 1, 2", (), METRIC_COLUMNS),
    "backtest_metrics_scopes": Query(lambda t: backtest.metrics_by_scope(backtest.naive_backtest(features.with_lags(cal.with_calendar(t("attendance")))), t("locations").select(F.col("id").alias("location_id"))), ctes("attendance", "locations") + f", {NAIVE}, m AS (SELECT location_id, coalesce(segment, 'overall') AS scope, {METRICS} FROM naive GROUP BY GROUPING SETS ((location_id), (location_id, segment))) SELECT l.id AS location_id, s.scope, MAE, RMSE, MAPE, Bias, P90AbsError, coalesce(BacktestRows, 0) AS BacktestRows FROM locations l CROSS JOIN (SELECT unnest(['overall', 'sat', 'sun']) AS scope) s LEFT JOIN m ON m.location_id = l.id AND m.scope = s.scope", (), METRIC_COLUMNS),
    "residual_buffer": Query(lambda t: backtest.residual_buffer(backtest.naive_backtest(features.with_lags(cal.with_calendar(t("attendance")))), t("locations").select(F.col("id").alias("location_id"), F.explode(F.array(F.lit("sat"), F.lit("sun"))).alias("segment"))), ctes("attendance", "locations") + f", {NAIVE}, r AS (SELECT location_id, segment, quantile_cont(greatest(actual - pred, 0), 0.8) AS residual_buffer FROM naive GROUP BY 1, 2) SELECT l.id AS location_id, s.segment, coalesce(residual_buffer, 0) AS residual_buffer FROM locations l CROSS JOIN (SELECT unnest(['sat', 'sun']) AS segment) s LEFT JOIN r ON r.location_id = l.id AND r.segment = s.segment", (), ("residual_buffer",)),
    # logs
    "logs_deduped": Query(lambda t: logs.dedupe(t("prediction_logs")), ctes("prediction_logs") + f", {LATEST} SELECT * EXCLUDE (n, many, f) REPLACE (coalesce(f, actual_visitors) AS actual_visitors, CASE WHEN many > 1 AND f IS NOT NULL THEN abs(f - predicted_visitors) ELSE absolute_error END AS absolute_error) FROM newest WHERE n = 1", LOG_TEXTS, LOG_DOUBLES),
    "logs_latest": Query(lambda t: logs.latest(t("prediction_logs")), ctes("prediction_logs") + f", {READ} SELECT * FROM latest", LOG_TEXTS, LOG_DOUBLES),
    "logs_with_actuals": Query(lambda t: logs.match_actuals(t("prediction_logs"), t("attendance")), ctes("prediction_logs", "attendance") + f", {LATEST} SELECT n.* EXCLUDE (n, many, f) REPLACE (coalesce(a.visitors, actual_visitors) AS actual_visitors, CASE WHEN a.visitors IS NOT NULL THEN abs(a.visitors - predicted_visitors) ELSE absolute_error END AS absolute_error, CASE WHEN a.visitors IS NOT NULL THEN suggested_meals * CAST(0.1 AS DOUBLE) ELSE waste_avoided_meals END AS waste_avoided_meals, CASE WHEN a.visitors IS NOT NULL THEN suggested_meals * CAST(0.1 AS DOUBLE) * 0.45 * 3.8 ELSE estimated_co2e_reduction_kg END AS estimated_co2e_reduction_kg), CASE WHEN a.visitors IS NOT NULL THEN many ELSE 0 END AS matched FROM newest n LEFT JOIN attendance a ON n.location_id = a.location_id AND n.service_date = a.service_date WHERE n.n = 1", LOG_TEXTS, LOG_DOUBLES),
    "logs_stale": Query(lambda t: logs.stale(t("prediction_logs"), t("attendance")), ctes("prediction_logs", "attendance") + " SELECT * FROM prediction_logs p WHERE NOT EXISTS (SELECT 1 FROM attendance a WHERE a.location_id = p.location_id AND a.service_date = p.service_date)", LOG_TEXTS, LOG_DOUBLES),
    "logs_kept": Query(lambda t: logs.kept(t("prediction_logs"), t("attendance")), ctes("prediction_logs", "attendance") + " SELECT * FROM prediction_logs p WHERE EXISTS (SELECT 1 FROM attendance a WHERE a.location_id = p.location_id AND a.service_date = p.service_date)", LOG_TEXTS, LOG_DOUBLES),
    "log_upsert": Query(lambda t: logs.upsert(t("prediction_logs"), _new_predictions(t)), ctes("prediction_logs") + f", {NEW_LOGS}, o AS (SELECT location_id, service_date, id AS oid, created_at AS oc, f FROM newest WHERE n = 1) SELECT * FROM prediction_logs p WHERE NOT EXISTS (SELECT 1 FROM fresh x WHERE x.location_id = p.location_id AND x.service_date = p.service_date) UNION ALL SELECT x.* REPLACE (coalesce(oid, id) AS id, coalesce(oc, created_at) AS created_at, f AS actual_visitors, abs(f - predicted_visitors) AS absolute_error) FROM fresh x LEFT JOIN o ON o.location_id = x.location_id AND o.service_date = x.service_date", LOG_TEXTS, LOG_DOUBLES),
    "logs_top_n": Query(lambda t: logs.newest_first(logs.latest(t("prediction_logs")), 200).select("id", "location_id", "service_date"), ctes("prediction_logs") + f", {READ} SELECT id, location_id, service_date FROM latest ORDER BY service_date DESC, prediction_created_at DESC, location_id DESC, id DESC LIMIT 200", DAY),
    "log_report": Query(lambda t: logs.report(logs.latest(t("prediction_logs"))), ctes("prediction_logs") + f", {READ} SELECT location_id, service_date, suggested_meals, model_segment, actual_visitors, {', '.join(f'round({c}, 2) AS {c}' for c in ('predicted_visitors', 'predicted_quantile', 'residual_buffer', 'absolute_error', 'waste_avoided_meals', 'estimated_co2e_reduction_kg'))} FROM latest", DAY),
    "api_response": Query(lambda t: logs.api_response(logs.latest(t("prediction_logs"))), ctes("prediction_logs") + f", {READ} SELECT location_id, strftime(service_date, '%Y-%m-%d') AS service_date, round(predicted_visitors, 2) AS predicted_visitors, round(predicted_quantile, 2) AS predicted_quantile, round(residual_buffer, 2) AS residual_buffer, suggested_meals, CAST(meal_buffer_pct AS DOUBLE) AS meal_buffer_pct, model_segment FROM latest"),
    "prediction_log_rows": Query(lambda t: logs.rows_of(t("prediction_logs").select("location_id", "service_date", "predicted_visitors", "suggested_meals"), "2024-01-06 10:00:00", "nightly", "job"), ctes("prediction_logs") + " SELECT location_id, service_date, predicted_visitors, suggested_meals, TIMESTAMP '2024-01-06 10:00:00' AS prediction_created_at, CAST(NULL AS INT) AS actual_visitors, CAST(NULL AS DOUBLE) AS absolute_error, 150 AS baseline_meals_prepared, suggested_meals * CAST(0.1 AS DOUBLE) AS waste_avoided_meals, suggested_meals * CAST(0.1 AS DOUBLE) * 0.45 * 3.8 AS estimated_co2e_reduction_kg, 'nightly' AS created_by, 'job' AS source_app, TIMESTAMP '2024-01-06 10:00:00' AS created_at, TIMESTAMP '2024-01-06 10:00:00' AS updated_at FROM prediction_logs", LOG_TEXTS, ("predicted_visitors", "absolute_error", "waste_avoided_meals", "estimated_co2e_reduction_kg")),
    "meal_recommendation": Query(lambda t: t("prediction_logs").select("id", _meals(t("prediction_logs")).alias("suggested_meals")), ctes("prediction_logs") + " SELECT id, CAST(ceil(greatest(predicted_visitors * (1 + coalesce(CASE WHEN id % 3 > 0 THEN CAST(meal_buffer_pct AS DOUBLE) * 2 END, CAST(0.08 AS DOUBLE))), coalesce(CASE WHEN id % 4 > 0 THEN predicted_quantile END, predicted_visitors), predicted_visitors + residual_buffer)) AS INT) AS suggested_meals FROM prediction_logs"),
    "savings_estimate": Query(lambda t: t("prediction_logs").select("id", val.waste_avoided(F.col("suggested_meals")).alias("waste"), val.co2e_avoided(F.col("suggested_meals")).alias("co2e")), ctes("prediction_logs") + " SELECT id, suggested_meals * CAST(0.1 AS DOUBLE) AS waste, suggested_meals * CAST(0.1 AS DOUBLE) * 0.45 * 3.8 AS co2e FROM prediction_logs", (), ("waste", "co2e")),
    "monitoring_summary": Query(lambda t: logs.monitoring_summary(t("prediction_logs")), ctes("prediction_logs") + f", {READ}, top AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY service_date DESC, prediction_created_at DESC, id DESC) AS n FROM latest) SELECT location_id, {SUMMARY} FROM top WHERE n <= 1000 GROUP BY 1", (), SUMMARY_DOUBLES),
    "monitoring_rollup": Query(lambda t: logs.monitoring_rollup(t("prediction_logs")), ctes("prediction_logs") + f", {READ} SELECT location_id, {SUMMARY} FROM latest GROUP BY ROLLUP (location_id)", (), SUMMARY_DOUBLES),
    # runs
    "latest_run": Query(lambda t: runs.latest(t("training_runs")), ctes("training_runs") + " SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY started_at DESC NULLS LAST, id DESC) AS n FROM training_runs) WHERE n = 1", ("started_at", "finished_at")),
    "latest_success_run": Query(lambda t: runs.latest_success(t("training_runs")), ctes("training_runs") + " SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY finished_at DESC NULLS LAST, started_at DESC NULLS LAST, id DESC) AS n FROM training_runs WHERE status = 'success') WHERE n = 1", ("started_at", "finished_at")),
    "run_status_counts": Query(lambda t: runs.status_counts(t("training_runs")), ctes("training_runs") + " SELECT count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed FROM training_runs"),
    "retrain_plan": Query(lambda t: runs.plan(attendance.state(t("attendance")).withColumn("latest_updated_at", F.concat(F.substring(F.col("latest_updated_at").cast("string"), 1, 10), F.lit("T00:00:00+00:00"))), t("training_runs"), 300), ctes("attendance", "training_runs") + """, s AS (SELECT location_id, count(*) AS n, concat(substr(CAST(max(updated_at) AS VARCHAR), 1, 10), 'T00:00:00+00:00') AS now FROM attendance GROUP BY 1),
      r AS (SELECT location_id, latest_attendance_updated_at AS old FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY finished_at DESC NULLS LAST, started_at DESC NULLS LAST, id DESC) AS n FROM training_runs WHERE status = 'success') WHERE n = 1),
      j AS (SELECT s.location_id, CASE WHEN n < 300 THEN concat('Only ', n, ' attendance rows; need at least 300.') WHEN try_cast(now AS TIMESTAMPTZ) <= try_cast(old AS TIMESTAMPTZ) OR (now <> '' AND now = old) THEN 'Attendance has not changed since the last successful training run.' END AS reason FROM s LEFT JOIN r ON s.location_id = r.location_id)
      SELECT location_id, CASE WHEN reason IS NULL THEN 'train' ELSE 'skip' END AS action, reason FROM j"""),
    "run_ledger": Query(
        _run_ledger,
        ctes("attendance", "training_runs")
        + f""", {RETRAIN}, {NAIVE}, e AS (SELECT location_id, CASE WHEN location_id LIKE '%7' AND fold % 10 = 0 THEN concat('fold ', fold) END AS error FROM naive),
          f AS (SELECT location_id, min(error) AS error, count(error) AS errors, count(*) AS results FROM e GROUP BY 1)
          SELECT j.location_id, CASE WHEN reason IS NOT NULL THEN 'skipped' WHEN coalesce(errors, 1) > 0 THEN 'failed' ELSE 'success' END AS status, '2024-01-06 02:00:00' AS started_at, CASE WHEN reason IS NULL THEN '2024-01-06 03:00:00' END AS finished_at, n AS attendance_rows, now AS latest_attendance_updated_at,
          CASE WHEN reason IS NOT NULL THEN reason WHEN results IS NULL THEN 'Backtest has no rows. Reduce min_train_size or provide more data.' WHEN errors > 0 THEN concat(error, ' (', errors, ' of ', results, ' fits)') END AS error_message FROM j LEFT JOIN f ON f.location_id = j.location_id""",
        ("started_at", "finished_at"),
    ),
    # users
    "user_look_up": Query(
        lambda t: access.audit_names(t("users_raw").select(F.when(F.col("seq") % 10 == 0, F.concat("username", F.lit("?"))).otherwise(F.upper("username")).alias("username")), t("users_raw")),
        ctes("users_raw")
        + f""", k AS (SELECT CASE WHEN seq % 10 = 0 THEN concat(username, '?') ELSE upper(username) END AS username FROM users_raw), n AS (SELECT *, lower({STRIP.format('username')}) AS key FROM users_raw QUALIFY row_number() OVER (PARTITION BY lower({STRIP.format('username')}) ORDER BY seq) = 1),
          a AS (SELECT key, CASE WHEN role NOT IN ('master', 'staff') THEN 'Role must be master or staff.' WHEN authorized_locations IS NULL THEN 'authorized_locations must be a list.' WHEN role = 'master' AND authorized_locations <> ['*'] THEN 'Master accounts must use authorized_locations [''*''].'
            WHEN role = 'staff' AND len(authorized_locations) = 0 THEN 'Staff account has no authorized locations.' WHEN role = 'staff' AND list_contains(authorized_locations, '*') THEN 'Wildcard ''*'' is only valid for master accounts.' WHEN len(list_filter(authorized_locations, lambda x: trim(x) = '')) > 0 THEN 'authorized_locations contains an invalid location id.'
            WHEN NOT has_hash THEN 'Missing password_hash.' WHEN NOT has_salt THEN 'Missing salt.' WHEN NOT has_iterations THEN 'Missing iterations.' ELSE 'User record is valid.' END AS reason, CASE WHEN has_hash AND has_salt AND has_iterations THEN 'hashed' ELSE 'plaintext' END AS account_type FROM n WHERE key <> ''),
          f AS (SELECT k.username, CASE WHEN {STRIP.format('k.username')} = '' THEN 'Username is empty.' ELSE coalesce(reason, 'Username does not exist.') END AS reason, account_type FROM k LEFT JOIN a ON a.key = lower({STRIP.format('k.username')})) SELECT *, reason = 'User record is valid.' AS passed FROM f""",
    ),
    "user_normalized": Query(lambda t: access.normalized(t("users_raw")).withColumn("authorized_locations", F.array_join("authorized_locations", ",")), ctes("users_raw") + f", {USERS} SELECT username, role, array_to_string(authorized_locations, ',') AS authorized_locations FROM named"),
    "duplicate_usernames": Query(lambda t: access.duplicate_usernames(t("users_raw")), ctes("users_raw") + f" SELECT lower({STRIP.format('username')}) AS username_key, count(*) AS records FROM users_raw GROUP BY 1 HAVING count(*) > 1"),
    "user_audit": Query(lambda t: access.audit(t("users_raw").withColumn("role", F.when(F.col("seq") % 4 == 0, F.col("role")).otherwise(val.role_of(F.col("role"))))), ctes("users_raw") + f""", u AS (SELECT * REPLACE (CASE WHEN seq % 4 = 0 THEN role ELSE {ROLE} END AS role) FROM users_raw), a AS (SELECT username, CASE WHEN {STRIP.format('username')} = '' THEN 'Username is empty.' WHEN role NOT IN ('master', 'staff') THEN 'Role must be master or staff.' WHEN authorized_locations IS NULL THEN 'authorized_locations must be a list.'
      WHEN role = 'master' AND authorized_locations <> ['*'] THEN 'Master accounts must use authorized_locations [''*''].' WHEN role = 'staff' AND len(authorized_locations) = 0 THEN 'Staff account has no authorized locations.' WHEN role = 'staff' AND list_contains(authorized_locations, '*') THEN 'Wildcard ''*'' is only valid for master accounts.'
      WHEN len(list_filter(authorized_locations, lambda x: trim(x) = '')) > 0 THEN 'authorized_locations contains an invalid location id.' WHEN NOT has_hash THEN 'Missing password_hash.' WHEN NOT has_salt THEN 'Missing salt.' WHEN NOT has_iterations THEN 'Missing iterations.' ELSE 'User record is valid.' END AS reason,
      CASE WHEN has_hash AND has_salt AND has_iterations THEN 'hashed' ELSE 'plaintext' END AS account_type FROM u) SELECT *, reason = 'User record is valid.' AS passed FROM a"""),
    "user_locations": Query(lambda t: access.visible_locations(access.normalized(access.first_of_name(t("users_raw"))), t("locations")), ctes("users_raw", "locations") + f", {USERS}, n AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY lower(username) ORDER BY seq) = 1) SELECT username, id AS location_id FROM n JOIN locations ON role = 'master' OR list_contains(authorized_locations, id)"),
    "assigned_location_labels": Query(lambda t: access.location_labels(access.normalized(access.first_of_name(t("users_raw"))), t("locations")), ctes("users_raw", "locations") + f", {USERS}, n AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY lower(username) ORDER BY seq) = 1), e AS (SELECT username, role, unnest(authorized_locations) AS loc, generate_subscripts(authorized_locations, 1) AS pos FROM n), l AS (SELECT username, string_agg(coalesce(name, concat('Unknown location (', loc, ')')), ', ' ORDER BY pos) AS label FROM e LEFT JOIN locations ON loc = id GROUP BY 1) SELECT n.username, CASE WHEN role = 'master' THEN 'All Locations' ELSE coalesce(label, 'None') END AS label FROM n LEFT JOIN l ON l.username = n.username"),
    "account_counts": Query(lambda t: access.account_counts(access.normalized(t("users_raw")), t("locations")), ctes("users_raw", "locations") + f", {USERS} SELECT count(*) AS users, count(*) FILTER (role = 'master') AS masters, count(*) FILTER (role = 'staff') AS staff, (SELECT count(*) FROM locations) AS locations FROM named"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def named(name: str, query: Query) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return query(spark, sf_dir)

        run.__name__ = name
        return run

    return {name: named(name, q) for name, q in QUERIES.items()} | workloads.queries()


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, q in QUERIES.items() if (sql := q.oracle())} | workloads.oracle_sql()
