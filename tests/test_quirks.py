"""Edge cases of the attendance operators on small hand-made tables."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from footfall.functions import calendar as cal
from footfall.functions import values as val
from footfall.operators import access, attendance, backtest, features, locations, logs, runs, schedule, weather

D = date


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_normalize_drops_before_it_keeps_the_last(spark):
    raw = [("a", "2024-01-06", "abc", 1), ("a", "2024-01-07", "2.5", 2), ("a", "2024-01-13", "3.5", 3), ("a", "2024-01-14", "-0.4", 4), ("a", "2024-01-20", "-1", 5), ("a", "2024-01-21", "5", 6), ("a", "2024-01-21", "x", 7), ("a", "2024-01-27", "0", 8), ("a", None, "3", 9)]
    df = spark.createDataFrame(raw, "location_id string, service_date string, visitors string, seq long")
    assert rows(attendance.normalize(df), "service_date", "visitors") == [(D(2024, 1, 7), 2), (D(2024, 1, 13), 4), (D(2024, 1, 14), 0), (D(2024, 1, 21), 5), (D(2024, 1, 27), 0)]


def grid(spark, *lines):
    schema = "source_id string, year string, row_idx int, slot string, team string, " + ", ".join(f"{m} string" for m in schedule.MONTHS)
    return spark.createDataFrame([(*line[:5], *line[5], *([None] * (12 - len(line[5])))) for line in lines], schema)


def test_schedule_quirks(spark):
    g = grid(
        spark,
        ("s", "2024", 3, " 2ND sun ", None, ["12.9", "x"]),
        ("s", "2024", 4, "5th Sun", "t", ["7", "7"]),
        ("s", "2024", 5, "10th Sat", "t", ["7"]),
        ("s", "2024", 6, "1st Sat", "t", ["5", "6"]),
        ("s", "2024", 7, "1st Sat", "t", ["0"]),
        ("s", "2024", 8, "Totals", None, ["99"]),
        ("s", "2024", 9, "3rd Sat", "t", ["99"]),
        ("s", "notes", 3, "3rd Sat", "t", ["99"]),
    )
    records = schedule.parse_grid(g)
    assert rows(records, "service_date", "visitors") == [(D(2024, 1, 6), 0), (D(2024, 1, 6), 5), (D(2024, 1, 14), 12), (D(2024, 2, 3), 6)]
    # the last of a key is 0, so the key is gone; sheets without totals keep all rows
    assert rows(schedule.clean_records(records), "service_date", "visitors") == [(D(2024, 1, 14), 12), (D(2024, 2, 3), 6)]
    assert schedule.parse_grid(grid(spark, ("s", "2023", 3, "5th Sat", None, ["1"] * 12))).count() == 4


def test_calendar_quirks(spark):
    days = [D(2024, 1, 6), D(2024, 1, 7), D(2024, 1, 10), D(2024, 1, 31)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = rows(df, "d", cal.slot_label(F.col("d")), cal.segment(F.col("d")), cal.next_service_date(F.col("d")))
    assert got == [(days[0], "1st Sat", "sat", D(2024, 1, 7)), (days[1], "1st Sun", "sun", D(2024, 1, 13)), (days[2], "2nd Sun", None, D(2024, 1, 13)), (days[3], "5th Sun", None, D(2024, 2, 3))]
    weekdays = backtest.with_segment(cal.with_calendar(df.withColumnRenamed("d", "service_date")))
    assert [r[0] for r in weekdays.orderBy("service_date").select("segment").collect()] == ["sat", "sun", "sat", "sat"]


def history(spark, n, start=D(2024, 1, 6)):
    days = [start.toordinal() + 7 * (i // 2) + i % 2 for i in range(n)]
    return spark.createDataFrame([(f"n{n}", D.fromordinal(d), 100 + i) for i, d in enumerate(days)], "location_id string, service_date date, visitors int")


@pytest.mark.parametrize(("n", "left"), [(1, 0), (2, 0), (3, 0), (4, 4), (5, 5)])
def test_training_frame_needs_four_rows(spark, n, left):
    assert features.training_frame(history(spark, n)).count() == left


def test_rolling_is_null_until_three_are_there_and_imputed_by_the_median(spark):
    lagged = {r["service_date"]: r["rolling_mean_3"] for r in features.with_lags(cal.with_calendar(history(spark, 5))).collect()}
    assert [lagged[d] for d in sorted(lagged)] == [None, None, None, 101.0, 102.0]
    frame = features.training_frame(history(spark, 5)).orderBy("service_date").collect()
    assert [r["rolling_mean_3"] for r in frame] == [101.5, 101.5, 101.5, 101.0, 102.0] and frame[0]["lag1"] == 101.5
    columns = [r["rolling_std_slot_3"] for r in frame]
    assert columns == [None] * 5  # no value at all stays null


def test_features_do_not_depend_on_partitions(spark):
    df = history(spark, 30)
    one = rows(features.training_frame(df.coalesce(1)))
    many = rows(features.training_frame(df.repartition(13)))
    assert one == many


def test_targets_only_after_the_history(spark):
    past = history(spark, 6)
    targets = spark.createDataFrame([("n6", D(2024, 1, 27))], "location_id string, service_date date")
    assert rows(features.target_features(past, targets), "lag1", "lag3") == [(105, 103)]
    early = spark.createDataFrame([("n6", D(2024, 1, 7))], "location_id string, service_date date")
    assert features.target_features(past, early).count() == 0


def test_weather_hours_sum_and_nulls(spark):
    at = lambda h: datetime(2024, 1, 6, h)
    hourly = spark.createDataFrame([("a", at(9), 0.0, None), ("a", at(10), 1.0, None), ("a", at(13), 3.0, None), ("a", at(14), 9.0, 5.0), ("b", at(11), None, 2.0), ("b", at(12), 4.0, 3.0)], "location_id string, time timestamp, temperature_2m double, precipitation double")
    for c in ("apparent_temperature", "relative_humidity_2m", "wind_speed_10m"):
        hourly = hourly.withColumn(c, F.col("temperature_2m"))
    assert rows(weather.daily(hourly), "location_id", "temp_10_13", "precip_10_13") == [("a", 2.0, 0.0), ("b", 4.0, 5.0)]


def test_metrics_with_a_zero_actual_and_fold_counts(spark):
    df = spark.createDataFrame([("a", "sat", 0.0, 1.0, 1.0)], "location_id string, segment string, actual double, pred double, abs_error double")
    assert backtest.metrics(df, ["location_id"]).first()["MAPE"] == pytest.approx(1 / 2.220446049250313e-16)
    for n, folds in ((18, 0), (19, 1)):
        saturdays = spark.createDataFrame([("a", D.fromordinal(D(2024, 1, 6).toordinal() + 7 * i), 5, 0) for i in range(n)], "location_id string, service_date date, visitors int, is_sun int")
        assert backtest.folds(backtest.with_segment(saturdays)).count() == folds
    none = spark.createDataFrame([], backtest_schema())
    spine = spark.createDataFrame([("a",)], "location_id string")
    assert rows(backtest.metrics_by_scope(none, spine), "scope", "BacktestRows") == [("overall", 0), ("sat", 0), ("sun", 0)]


def backtest_schema():
    from footfall.schemas import BACKTEST

    return BACKTEST


LOG = "id long, location_id string, service_date date, prediction_created_at timestamp, predicted_visitors double, suggested_meals int, actual_visitors int, absolute_error double, created_at timestamp, waste_avoided_meals double, estimated_co2e_reduction_kg double"


def log(i, day, made, pred, actual=None, error=None):
    t = datetime(2024, 1, 1, made)
    return (i, "a", D(2024, 1, day), t, pred, 10, actual, error, t, 1.0, 1.71)


def test_logs_keep_the_newest_and_the_first_known_actual(spark):
    df = spark.createDataFrame([log(1, 6, 1, 90.0, 70, 20.0), log(2, 6, 2, 95.0, 80, 15.0), log(3, 6, 2, 100.0), log(4, 7, 1, 50.0), log(5, 13, 1, 40.0, 44)], LOG)
    assert rows(logs.latest(df), "id", "actual_visitors", "absolute_error") == [(3, 80, 20.0), (4, None, None), (5, 44, None)]
    assert rows(logs.dedupe(df), "id", "actual_visitors", "absolute_error") == [(3, 80, 20.0), (4, None, None), (5, 44, None)]
    newest_has_its_own = spark.createDataFrame([log(1, 6, 1, 90.0, 70, 1.0), log(2, 6, 2, 95.0, 80, 2.0)], LOG)
    assert rows(logs.latest(newest_has_its_own), "id", "absolute_error") == [(2, 2.0)]
    assert rows(logs.dedupe(newest_has_its_own), "id", "absolute_error") == [(2, 15.0)]


def test_log_upsert_keeps_the_actual_and_the_time_of_creation(spark):
    old = spark.createDataFrame([log(1, 6, 1, 90.0, 70, 20.0), log(2, 6, 2, 95.0)], LOG)
    new = spark.createDataFrame([log(9, 6, 5, 60.0), log(10, 20, 5, 61.0)], LOG)
    got = {r["id"]: r for r in logs.upsert(old, new).collect()}
    assert set(got) == {2, 10}
    assert (got[2]["actual_visitors"], got[2]["absolute_error"], got[2]["predicted_visitors"], got[2]["created_at"].hour) == (70, 10.0, 60.0, 2)
    assert rows(logs.upsert(logs.upsert(old, new), new), "id") == rows(logs.upsert(old, new), "id")


def test_monitoring_counts_savings_without_actuals(spark):
    df = spark.createDataFrame([log(1, 6, 1, 90.0, 70, 20.0), log(2, 7, 2, 95.0)], LOG)
    r = logs.monitoring_summary(df).first()
    assert (r["live_mae"], r["logs_with_actuals"], r["total_waste_avoided"]) == (20.0, 1, 2.0)


def test_stale_logs_include_those_without_a_key(spark):
    df = spark.createDataFrame([log(1, 6, 1, 90.0), log(2, 7, 1, 90.0)], LOG).withColumn("location_id", F.when(F.col("id") == 1, "a"))
    there = spark.createDataFrame([("a", D(2024, 1, 6), 5)], "location_id string, service_date date, visitors int")
    assert rows(logs.stale(df, there), "id") == [(2,)] and rows(logs.kept(df, there), "id") == [(1,)]


def test_runs(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    df = spark.createDataFrame([(1, "a", "success", t(1), t(2), "2024-01-01T00:00:00Z"), (2, "a", "success", t(3), None, "x"), (3, "a", "running", None, None, None), (4, "b", "success", t(1), t(2), "odd"), (5, "c", "success", t(1), t(1), "2024-01-05")], "id long, location_id string, status string, started_at timestamp, finished_at timestamp, latest_attendance_updated_at string")
    assert rows(runs.latest_success(df), "id") == [(1,), (4,), (5,)] and rows(runs.latest(df), "id") == [(2,), (4,), (5,)]
    state = spark.createDataFrame([("a", 30, "2024-01-01T00:00:00+00:00"), ("b", 30, "odd"), ("c", 30, None), ("d", 30, "2024-01-01"), ("e", 17, "2024-01-01")], "location_id string, attendance_rows long, latest_updated_at string")
    assert rows(runs.plan(state, df), "location_id", "action") == [("a", "skip"), ("b", "skip"), ("c", "train"), ("d", "train"), ("e", "skip")]
    assert rows(runs.plan(state, df, force=True), "location_id", "action") == [("a", "train"), ("b", "train"), ("c", "train"), ("d", "train"), ("e", "skip")]
    appended = spark.createDataFrame([(1, 1, "running", None), (1, 2, "failed", "no"), (2, 1, "running", None)], "id long, seq int, status string, error_message string")
    assert rows(runs.current(appended), "id", "status") == [(1, "failed"), (2, "running")]


def test_users(spark):
    df = spark.createDataFrame([(" Bob ", "ADMIN", ["x"], True, True, True), ("bob", "guest", [" a ", ""], True, False, True), ("eve", "staff", ["*"], True, True, True), ("ann", "staff", [], True, True, True), ("joe", None, None, True, True, True)], "username string, role string, authorized_locations array<string>, has_hash boolean, has_salt boolean, has_iterations boolean")
    assert rows(access.normalized(df))[:2] == [("Bob", "master", ["*"]), ("ann", "staff", [])]
    assert rows(access.duplicate_usernames(df)) == [("bob", 2)]
    reasons = {r["username"]: r["reason"] for r in access.audit(df).collect()}
    assert reasons["bob"] == "Role must be master or staff." and reasons["eve"].startswith("Wildcard") and reasons["ann"].startswith("Staff account has no")
    places = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, name string")
    assert rows(access.visible_locations(access.normalized(df), places)) == [("Bob", "a"), ("Bob", "b"), ("bob", "a")]
    assert dict(rows(access.location_labels(access.normalized(df), places))) == {"Bob": "All Locations", "bob": "A", "eve": "Unknown location (*)", "ann": "None", "joe": "None"}


def test_replace_with_nothing_empties_a_location(spark):
    old = spark.createDataFrame([("a", D(2024, 1, 6), 1), ("b", D(2024, 1, 6), 2)], "location_id string, service_date date, visitors int")
    a = spark.createDataFrame([("a",)], "location_id string")
    assert rows(attendance.replace(old, old.limit(0), a), "location_id") == [("b",)]
    new = spark.createDataFrame([("a", D(2024, 1, 7), 9)], old.schema)
    assert rows(attendance.upsert(attendance.upsert(old, new), new)) == rows(attendance.upsert(old, new))
    assert rows(attendance.bootstrap(old, new)) == rows(old)


def test_values(spark):
    df = spark.createDataFrame([("12.9",), ("-3.9",), ("nan",), ("inf",), ("x",), (None,), (" 7 ",)], "v string")
    assert [r[0] for r in df.select(val.whole_or_null(F.col("v"))).collect()] == [12, -3, None, None, None, None, 7]
    meals = spark.createDataFrame([(100.0, None, 0.0, None), (100.0, 120.5, 5.0, 0.5), (100.0, 90.0, 30.2, 0.0)], "p double, q double, r double, b double")
    assert [r[0] for r in meals.select(val.suggested_meals(F.col("p"), F.col("q"), F.col("r"), F.col("b"))).collect()] == [108, 150, 131]
    names = spark.createDataFrame([("\tA b\n",), ("a_b",)], "id string")
    assert rows(locations.safe_ids(names), "safe_id", "sharing") == [("a_b", 2), ("a_b", 2)]
