"""Bucketed tables, the run ledger, keyed stream state, late actuals, site time, workbooks and sinks."""

import zipfile
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from footfall.config import MONTHS
from footfall.operators import attendance, backtest, logs, runs, schedule, weather
from footfall.plans import nightly, workloads
from footfall.sources import bucketed, files, workbook
from footfall.streaming import jobs

ATTENDANCE = "location_id string, service_date date, visitors int"


def upserted(current, changes):
    return changes if current is None else attendance.upsert(current, changes)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_change_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    root = str(tmp_path / "t")
    first = spark.createDataFrame([(f"s{i}", date(2024, 1, 6), i) for i in range(40)] + [(None, date(2024, 1, 6), 99)], ATTENDANCE)
    assert bucketed.merge(first, root, "location_id", upserted, "0", buckets=16)
    before = {r["bucket"]: r["path"] for r in bucketed.manifest(spark, root).collect()}
    stamps = {f: f.stat().st_mtime_ns for f in Path(root, "data").rglob("*.parquet")}
    change = spark.createDataFrame([("s3", date(2024, 1, 6), 1000), ("s3", date(2024, 1, 7), 5)], ATTENDANCE)
    assert bucketed.merge(change, root, "location_id", upserted, "1")
    after = {r["bucket"]: r["path"] for r in bucketed.manifest(spark, root).collect()}
    assert sum(after[b] != before[b] for b in before) == 1 and before.keys() == after.keys()
    assert all(f.stat().st_mtime_ns == t for f, t in stamps.items())
    want = rows(attendance.upsert(first, change))
    assert rows(bucketed.read(spark, root)) == want
    # a repeated batch changes nothing, not even the files
    held = sorted(map(str, Path(root).rglob("*")))
    assert not bucketed.merge(change.withColumn("visitors", F.lit(0)), root, "location_id", upserted, "1")
    assert sorted(map(str, Path(root).rglob("*"))) == held and rows(bucketed.read(spark, root)) == want


def test_locations_can_lose_all_rows_and_a_failed_change_shows_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    first = spark.createDataFrame([("a", date(2024, 1, 6), 1), ("b", date(2024, 1, 6), 2)], ATTENDANCE)
    bucketed.merge(first, root, "location_id", upserted)
    gone = spark.createDataFrame([("a",)], "location_id string")
    bucketed.merge(first.limit(0), root, "location_id", lambda current, new: attendance.replace(current, new, gone), touched=gone)
    assert rows(bucketed.read(spark, root)) == [("b", date(2024, 1, 6), 2)]
    with pytest.raises(ValueError, match="buckets"):
        bucketed.merge(first.filter("location_id = 'b'"), root, "location_id", lambda current, new: first.unionByName(first.withColumn("location_id", F.concat(F.lit("z"), F.col("visitors").cast("string")))))
    assert rows(bucketed.read(spark, root)) == [("b", date(2024, 1, 6), 2)]
    with pytest.raises(FileNotFoundError):
        bucketed.read(spark, str(tmp_path / "none"))


LOG = "id long, location_id string, service_date date, prediction_created_at timestamp, predicted_visitors double, actual_visitors int, absolute_error double"


def log(i, place, day, hour, predicted, actual=None):
    return (i, place, date(2024, 1, 1) + timedelta(day - 1), datetime(2024, 1, 1, 0) + timedelta(hours=hour), float(predicted), actual, None if actual is None else abs(actual - float(predicted)))


def test_keyed_log_state_equals_the_batch_form_also_after_a_restart(spark, tmp_path):
    batches = [
        [log(1, "a", 6, 1, 10, 8), log(2, "a", 6, 2, 12), log(3, "b", 6, 1, 5)],
        [log(4, "a", 6, 0, 99, 7), log(5, "b", 6, 9, 6), log(6, None, 6, 1, 4, 4)],
        [log(7, "a", 6, 2, 13), log(8, "b", 6, 8, 7, 3), log(9, "c", 7, 1, 1)],
    ]
    source, root, checkpoint = str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c")
    for batch in batches:  # a new query each time, from the checkpoint of the one before
        spark.createDataFrame(batch, LOG).coalesce(1).write.mode("append").parquet(source)
        feed = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(source)
        jobs.log_feed(feed, root, checkpoint).trigger(availableNow=True).start().awaitTermination()
    want = logs.latest(spark.createDataFrame(sum(batches, []), LOG))
    assert rows(bucketed.read(spark, root).select(want.columns)) == rows(want)
    got = {r["location_id"]: r for r in bucketed.read(spark, root).collect()}
    assert (got["a"]["id"], got["a"]["actual_visitors"], got["a"]["absolute_error"]) == (7, 8, 5.0) and got["b"]["actual_visitors"] == 3


def test_a_log_that_comes_again_has_its_newer_actual(spark, tmp_path, monkeypatch):
    places = [f"p{i}" for i in range(40)]
    batches = [
        [r for i, p in enumerate(places) for r in (log(1000 + i, p, 6, 9, 10), log(i, p, 6, 1, 10, 5))],
        [log(100 + i, p, 6, 2, 10, 7) for i, p in enumerate(places)],
        [log(200 + i, p, 6, 3, 10, 3) for i, p in enumerate(places)],
    ]
    source, root = str(tmp_path / "in"), str(tmp_path / "t")
    for batch in batches:
        spark.createDataFrame(batch, LOG).coalesce(1).write.mode("append").parquet(source)
    feed = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.log_feed(feed, root, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    want = logs.latest(spark.createDataFrame(sum(batches, []), LOG))
    assert rows(bucketed.read(spark, root).select(want.columns)) == rows(want)
    one = lambda actual: spark.createDataFrame([log(1, "a", 6, 9, 10, actual)], LOG)
    union = type(want).unionByName
    for turned in (False, True):  # executors fetch the rows of a key in any order
        if turned:
            monkeypatch.setattr(type(want), "unionByName", lambda own, other: union(other, own))
        for was, now, left in ((5, 7, 7), (7, 5, 5), (5, None, 5)):
            merged = jobs.merge_logs(one(was), one(now)).first()
            assert (merged["actual_visitors"], merged["absolute_error"]) == (left, 10.0 - left)


def test_state_of_old_keys_goes(spark, tmp_path):
    source = str(tmp_path / "in")
    for batch in ([log(1, "old", 6, 1, 10)], [log(2, "new", 300, 2, 5)], [log(3, "newer", 301, 3, 5)], [log(4, "too late", 6, 4, 5)]):
        spark.createDataFrame(batch, LOG).coalesce(1).write.mode("append").parquet(source)
    feed = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(source)
    query = jobs.log_feed(feed, str(tmp_path / "t"), str(tmp_path / "c"), "10 days").trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 2 and jobs.rows_too_late(query) == 1
    assert bucketed.read(spark, str(tmp_path / "t")).count() == 3  # the table keeps what the state forgets


def test_actuals_in_time_late_and_missing(spark, tmp_path):
    t = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    made, came = str(tmp_path / "made"), str(tmp_path / "came")
    left, right = "location_id string, service_date date, predicted_at timestamp, predicted_visitors double", "location_id string, service_date date, arrived_at timestamp, visitors int"
    day = lambda d: t(d).date()
    batches = [
        ([("in time", day(0), t(0), 1.0), ("late", day(0), t(0), 2.0), ("missing", day(0), t(0), 3.0), ("far", day(0), t(0), 4.0)], [("in time", day(0), t(3), 10), ("other", day(0), t(3), 11)]),
        ([("x", day(60), t(60), 5.0)], [("x", day(60), t(61), 12), ("far", day(0), t(50), 13)]),
        ([("w", day(80), t(80), 5.5)], [("w", day(80), t(81), 16)]),
        ([("y", day(90), t(90), 6.0)], [("late", day(0), t(2), 14), ("y", day(90), t(91), 15)]),
        ([("end", day(900), t(900), 0.0)], [("end2", day(900), t(900), 0)]),
    ]
    for p, a in batches:
        spark.createDataFrame(p, left).coalesce(1).write.mode("append").parquet(made)
        spark.createDataFrame(a, right).coalesce(1).write.mode("append").parquet(came)
    streams = [spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(f) for s, f in ((left, made), (right, came))]
    query = jobs.matched_actuals(*streams, "14 days").writeStream.format("memory").queryName("matched").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["location_id"]: r["actual_visitors"] for r in spark.table("matched").collect()}
    assert {k: v for k, v in got.items() if k != "end"} == {"in time": 10, "late": None, "missing": None, "far": None, "x": 12, "w": 16, "y": 15}
    assert jobs.rows_too_late(query) == 1


def test_runs_start_and_end_once_and_name_their_errors(spark, tmp_path):
    root = str(tmp_path / "ledger")
    planned = spark.createDataFrame([("a", "train", None), ("b", "train", None), ("c", "skip", "why"), ("d", "train", None)], "location_id string, action string, reason string")
    state = spark.createDataFrame([(x, 40, "2024-01-01") for x in "abcd"], "location_id string, attendance_rows long, latest_updated_at string")
    begun = runs.started(planned, state, F.lit("2024-01-06 02:00:00"))
    for _ in range(2):  # a task that runs again
        runs.record(begun, root)
    assert rows(runs.ledger(spark, root).select("location_id", "status", "error_message")) == [("a", "running", None), ("b", "running", None), ("c", "skipped", "why"), ("d", "running", None)]
    results = spark.createDataFrame([("a", None), ("a", None), ("b", None), ("b", "worse"), ("b", "bad")], "location_id string, error_message string")
    metrics = spark.createDataFrame([("a", "{}"), ("b", "{}")], "location_id string, metrics string")
    ended = runs.finished(runs.ledger(spark, root), results, F.lit("2024-01-06 03:00:00"), metrics)
    runs.record(ended, root, "end")
    runs.record(ended, root, "end")
    now = runs.ledger(spark, root)
    assert rows(now.select("location_id", "status", "error_message", "metrics")) == [("a", "success", None, "{}"), ("b", "failed", "bad (2 of 3 fits)", None), ("c", "skipped", "why", None), ("d", "failed", runs.NO_FITS, None)]
    assert tuple(runs.status_counts(now).first()) == (1, 1, 2)
    assert bucketed.read(spark, root).count() == 7


def test_one_failing_site_leaves_a_night_whole(spark, tmp_path, monkeypatch):
    first = date(2024, 1, 6)
    days = [first + timedelta(7 * (i // 2) + i % 2) for i in range(44)]
    table = [(p, d, 100 + 7 * i % 31, datetime(2024, 9, 1)) for p in ("good", "bad") for i, d in enumerate(days)] + [("small", days[0], 5, datetime(2024, 9, 1))]
    table = spark.createDataFrame(table, "location_id string, service_date date, visitors int, updated_at timestamp")
    real = nightly.features.training_frame

    def broken(*args, **kwargs):
        frame = real(*args, **kwargs)
        return frame.withColumn("lag1", F.when(F.col("location_id") == "bad", F.lit(float("nan"))).otherwise(F.col("lag1")))

    monkeypatch.setattr(nightly.features, "training_frame", broken)
    night = lambda at: nightly.retrain(table, None, str(tmp_path / "l"), str(tmp_path / "m"), at, n_trees=2, rounds=1)
    got = {r["location_id"]: r for r in night("2024-09-02 02:00:00").collect()}
    assert {k: r["status"] for k, r in got.items()} == {"good": "success", "bad": "failed", "small": "skipped"}
    assert "finite" in got["bad"]["error_message"] and "Only 1 attendance rows" in got["small"]["error_message"]
    scopes = {r["scope"]: r["BacktestRows"] for r in backtest.metrics_of_json(spark.createDataFrame([("good", got["good"]["metrics"])], "location_id string, metrics string")).collect()}
    assert scopes == {"overall": 8, "sat": 4, "sun": 4}
    # the next night nothing has changed but for the site that failed
    again = {r["location_id"]: r["status"] for r in night("2024-09-03 02:00:00").collect()}
    assert again == {"good": "skipped", "bad": "failed", "small": "skipped"}


def test_days_of_23_and_25_hours(spark):
    places = spark.createDataFrame([("ny", "America/New_York"), ("be", "Europe/Berlin")], "id string, timezone string")
    hours = [("ny", datetime(2024, 3, 9) + timedelta(hours=h)) for h in range(72)] + [("be", datetime(2024, 10, 26) + timedelta(hours=h)) for h in range(72)] + [("none", datetime(2024, 11, 2) + timedelta(hours=h)) for h in range(72)]
    utc = spark.createDataFrame([(p, t, float(t.hour), 0.0, 0.0, 0.0, 1.0) for p, t in hours], "location_id string, time timestamp_ntz, temperature_2m double, apparent_temperature double, relative_humidity_2m double, wind_speed_10m double, precipitation double")
    local = weather.in_site_time(utc, places)
    counts = {(r[0], r[1]): r[2] for r in local.groupBy("location_id", F.to_date("time")).agg(F.count(F.lit(1))).collect()}
    assert counts["ny", date(2024, 3, 10)] == 23 and counts["be", date(2024, 10, 27)] == 25 and counts["none", date(2024, 11, 3)] == 25
    daily = {(r["location_id"], r["date"]): r for r in weather.daily(local).collect()}
    assert daily["ny", date(2024, 3, 9)]["temp_10_13"] == 16.5  # 15 to 18 UTC
    assert daily["ny", date(2024, 3, 10)]["temp_10_13"] == 15.5  # 14 to 17 UTC
    assert daily["be", date(2024, 10, 26)]["temp_10_13"] == 9.5 and daily["be", date(2024, 10, 27)]["temp_10_13"] == 10.5


def write_workbook(path, sheets):
    """A workbook of shared, inline and numeric cells; None leaves a cell out."""
    ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shared: list[str] = []

    def cell(column, row, value):
        at = f"{chr(65 + column)}{row}" if column < 26 else f"A{chr(39 + column)}{row}"
        if isinstance(value, (int, float)):
            return f'<c r="{at}"><v>{value}</v></c>'
        if value.startswith("!"):
            return f'<c r="{at}" t="inlineStr"><is><t>{value[1:]}</t></is></c>'
        shared.append(value)
        return f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>'

    with zipfile.ZipFile(path, "w") as book:
        for i, (_, grid) in enumerate(sheets):
            body = "".join(f'<row r="{r + 1}">' + "".join(cell(c, r + 1, v) for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(grid) if row)
            book.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{ns}"><sheetData>{body}</sheetData></worksheet>')
        listed = "".join(f'<sheet name="{name}" sheetId="{i + 1}" r:id="r{i}"/>' for i, (name, _) in enumerate(sheets))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        targets = "".join(f'<Relationship Id="r{i}" Target="{"/xl/" if i % 2 else ""}worksheets/s{i}.xml"/>' for i in range(len(sheets)))
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{targets}</Relationships>')
        strings = "".join(f"<si><r><t>{s[:2]}</t></r><r><t>{s[2:]}</t></r><rPh><t>no</t></rPh></si>" for s in shared)
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}">{strings}</sst>')


GRID = [
    ["Schedule"], [], ["Slot", "Team", *MONTHS, "Jan"],
    ["1st Sat", "red", *range(10, 22), 999], ["!2nd Sun", None, 7.9, None, "closed", *["5"] * 9], [None, "x"], ["5th Sat", "late", *[3] * 12], ["Totals", None, *[1] * 12], ["1st Sun", "below", *[9] * 12],
]


def test_a_workbook_equals_the_landed_grid(spark, tmp_path):
    folder = tmp_path / "books"
    folder.mkdir()
    write_workbook(folder / "site a.xlsx", [("2024", GRID), ("notes", GRID), ("2023", GRID)])
    landed = [("site a", y, i, row[0] and row[0].lstrip("!"), row[1] if len(row) > 1 else None, *([None if v is None else str(v) for v in row[2:14]] + [None] * 12)[:12]) for y in ("2024", "2023") for i, row in enumerate(GRID) if i > 2]
    grid = spark.createDataFrame(landed, files.schemas.SCHEDULE_GRID)
    read = workbook.read_workbooks(spark, str(folder))
    assert rows(read) == rows(grid)
    assert rows(workbook.read_service_records(spark, str(folder))) == rows(schedule.clean_records(schedule.parse_grid(grid)))
    grid.coalesce(1).write.option("header", True).csv(str(tmp_path / "csv"))
    assert rows(files.read_schedule_grids(spark, str(tmp_path / "csv"))) == rows(grid)
    write_workbook(tmp_path / "none.xlsx", [("notes", GRID), ("2024", GRID[:3])])
    with pytest.raises(ValueError, match="No service records"):
        workbook.read_service_records(spark, str(tmp_path / "none.xlsx"))


def test_predictions_metrics_and_attendance_are_written_and_read(spark, tmp_path):
    first = date(2024, 1, 6)
    days = [first + timedelta(7 * (i // 2) + i % 2) for i in range(50)]
    folds = spark.createDataFrame([("a", "sun" if d.weekday() == 6 else "sat", d, 100.0 + i, 103.0, abs(3.0 - i), int(d.weekday() == 6)) for i, d in enumerate(reversed(days))], "location_id string, segment string, service_date date, actual double, pred double, abs_error double, is_sun int").repartition(5)
    files.write_predictions(folds, str(tmp_path / "p"))
    again = spark.read.parquet(str(tmp_path / "p"))
    assert rows(again.select(folds.columns)) == rows(folds)
    one = spark.read.parquet(str(tmp_path / "p" / "location_id=a" / "segment=sat"))
    dates = [r[0] for r in one.select("service_date").collect()]
    assert dates == sorted(dates) and len(dates) == 25
    scoped = backtest.metrics_by_scope(folds, spark.createDataFrame([("a",), ("b",)], "location_id string"))
    files.write_metrics(backtest.metrics_json(scoped), str(tmp_path / "m"))
    back = backtest.metrics_of_json(files.read_metrics(spark, str(tmp_path / "m")))
    assert rows(back.select(scoped.columns)) == rows(scoped)
    assert {r["metrics"] for r in files.read_metrics(spark, str(tmp_path / "m")).filter("location_id = 'b'").collect()} == {'{"overall":{"BacktestRows":0},"sat":{"BacktestRows":0},"sun":{"BacktestRows":0}}'}
    table = spark.createDataFrame([("a", d, i) for i, d in enumerate(reversed(days))], ATTENDANCE).repartition(4)
    files.write_attendance(table, str(tmp_path / "t"))
    read = [r["service_date"] for r in spark.read.parquet(str(tmp_path / "t")).collect()]
    assert read == sorted(days)


def test_dropped_actuals_are_counted_in_the_registered_stream(spark):
    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no test tables")
    rows_, late = workloads.late_actuals(spark, "/root/testdata/sf0.001")
    kinds = F.dayofmonth(F.to_date("service_date")) % 7
    assert late > 0 and rows_.filter((kinds == 5) & F.col("actual_visitors").isNotNull()).count() == 0
    assert rows_.filter(F.col("actual_visitors").isNotNull()).count() > 100 and rows_.filter(F.col("actual_visitors").isNull()).count() > 100
