import json
from datetime import date, datetime

from pyspark.sql import functions as F

from footfall.plans import workloads
from footfall.sources import bucketed, files
from footfall.streaming import jobs


def test_locations_round_trip(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"locations": [{"id": " a ", "name": "", "zip_code": "1"}, {"id": " "}, {"id": "b", "name": "B", "country_code": "DE", "timezone": " Europe/Berlin"}]}, indent=1))
    read = files.read_locations(spark, str(tmp_path / "l.json"))
    want = [("a", "a", "1", "US", "America/New_York"), ("b", "B", "", "DE", "Europe/Berlin")]
    assert sorted(map(tuple, read.collect())) == want
    files.write_locations(read, str(tmp_path / "out"))
    assert sorted(map(tuple, files.read_locations(spark, str(tmp_path / "out")).collect())) == want


def test_users_in_both_forms(spark, tmp_path):
    users = [{"username": "A", "role": "admin", "authorized_locations": ["*"], "password_hash": "x", "salt": "y", "iterations": 5}, {"username": " "}, {"username": "b", "role": "odd"}]
    for name, body in (("o.json", {"users": users}), ("b.json", users)):
        (tmp_path / name).write_text(json.dumps(body))
        got = sorted((r["username"], r["role"], r["has_hash"], r["has_iterations"]) for r in files.read_users(spark, str(tmp_path / name)).collect())
        assert got == [("A", "master", True, True), ("b", "staff", False, False)]


def test_csv_weather_and_versions(spark, tmp_path):
    (tmp_path / "v.csv").write_text("service_date,visitors,year,month,slot,team\n2024-01-06,5,2024,1,1st Sat,t\n")
    rows = files.read_attendance_csv(spark, str(tmp_path / "v.csv"), "a")
    assert [tuple(r) for r in rows.collect()] == [("a", date(2024, 1, 6), 5)]
    (tmp_path / "w.csv").write_text("location_id,date,temp_10_13,apparent_temp_10_13,humidity_10_13,wind_10_13,precip_10_13\n")
    assert files.read_weather_cache(spark, str(tmp_path / "w.csv")) is None
    root = str(tmp_path / "t")
    files.write_version(rows, root)
    again = files.read_version(spark, root).unionByName(rows.withColumn("location_id", F.lit("b")))
    files.write_version(again, root)
    assert files.read_version(spark, root).count() == 2


def test_older_changes_never_replace_newer_ones(spark):
    schema = "location_id string, service_date date, visitors int, updated_at timestamp"
    t = lambda h: datetime(2024, 1, 1, h)
    now = spark.createDataFrame([("a", date(2024, 1, 6), 5, t(5))], schema)
    batch = spark.createDataFrame([("a", date(2024, 1, 6), 1, t(1)), ("b", date(2024, 1, 6), 2, t(1)), ("b", date(2024, 1, 6), 3, t(2))], schema)
    once = jobs.merge_attendance(now, batch)
    assert sorted((r["location_id"], r["visitors"]) for r in once.collect()) == [("a", 5), ("b", 3)]
    assert sorted(map(tuple, jobs.merge_attendance(once, batch).collect())) == sorted(map(tuple, once.collect()))


def test_weather_in_no_order_of_time_is_whole(spark, tmp_path, monkeypatch):
    """Files of a table as micro-batches, whose days begin anew in each: nothing of it is late."""
    t = lambda d: datetime(2024, 1, d, 11)
    rows = [("a", t(d), float(10 * i + d), 1.0, 2.0, 3.0, 0.5) for i in range(3) for d in (1, 9, 20)]
    hourly = spark.createDataFrame(rows, "location_id string, time timestamp, temperature_2m double, apparent_temperature double, relative_humidity_2m double, wind_speed_10m double, precipitation double")
    folder = str(tmp_path / "in")
    for i in range(3):
        hourly.filter(F.col("temperature_2m") - F.dayofmonth("time") == 10 * i).coalesce(1).write.mode("append").parquet(folder)
    feed = spark.readStream.schema(hourly.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    monkeypatch.setattr(workloads, "fixture", lambda spark, sf_dir, name: hourly)
    monkeypatch.setattr(workloads, "_stream", lambda df, folder: feed)
    got = sorted((r["date"], r["temp_10_13"], r["precip_10_13"]) for r in workloads.stream_weather(spark, "").collect())
    assert got == [("2024-01-01", 11.0, 1.5), ("2024-01-09", 19.0, 1.5), ("2024-01-20", 30.0, 1.5)]


def test_micro_batches_are_few_however_many_files(spark, tmp_path):
    table = spark.range(300).select(F.col("id").cast("string").alias("location_id"), F.to_date(F.lit("2024-01-06")).alias("service_date"), F.col("id").cast("int").alias("visitors"), F.timestamp_seconds("id").alias("updated_at"))
    for name, files, most in (("few", 3, 1), ("many", 100, workloads.BATCHES)):
        feed, seen = workloads._stream(table.repartition(files), str(tmp_path / name)), []
        query = feed.writeStream.foreachBatch(lambda batch, i: seen.append(batch.count())).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert sum(seen) == 300 and len(seen) <= most


def test_a_feed_deals_one_change_of_each_key(spark, tmp_path, monkeypatch):
    schema, dealt, real = "location_id string, service_date date, visitors int, updated_at timestamp", [], bucketed.merge
    changes = [("a", date(2024, 1, 6), i, datetime(2024, 1, 1, 1 + i % 20)) for i in range(60)]
    spark.createDataFrame(changes, schema).write.parquet(str(tmp_path / "in"))
    monkeypatch.setattr(jobs.bucketed, "merge", lambda batch, *rest: dealt.append(batch.count()) or real(batch, *rest))
    feed = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    jobs.attendance_feed(feed, str(tmp_path / "t"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert dealt == [1] and [r["visitors"] for r in bucketed.read(spark, str(tmp_path / "t")).collect()] == [59]
