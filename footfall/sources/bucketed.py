"""Keyed tables whose changes rewrite only the buckets they touch.

Rows lie in buckets by a hash of one column, each bucket in a folder of its own that is never written twice. A manifest, an
appended Parquet table, notes for each change its number, the batch it came from, and the new folder of every bucket it
touched; a bucket's latest note counts. The note is one row group written when all data is, so readers see a change whole or not at all,
and a change that failed half-way leaves only folders that nothing points to. A batch that is noted already
changes nothing when it comes again.

One writer at a time: two that start from the same state would both be noted, and the later one would win for the buckets that both touch.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

#: Buckets of a new table.
BUCKETS = 64
NOTE = "change long, batch string, buckets int, bucket int, path string, columns string"
BUCKET = "__bucket"


def bucket_of(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def _notes(spark: SparkSession, root: str) -> DataFrame:
    """All notes; none if there is no table yet."""
    try:
        return spark.read.schema(NOTE).parquet(f"{root}/manifest")
    except AnalysisException:
        return spark.createDataFrame([], NOTE)


def _latest(notes: DataFrame, seen: Column) -> DataFrame:
    note = F.max_by(F.struct("path", "change", "buckets", "columns"), "change").alias("note")
    return notes.groupBy("bucket").agg(note, seen.alias("seen")).select("bucket", "note.*", "seen")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """bucket, path, change, columns: the folder that holds each bucket, null where a change left nothing in it."""
    return _latest(_notes(spark, root), F.lit(0)).select("bucket", "path", "change", "columns")


def _read(spark: SparkSession, held: list) -> DataFrame | None:
    if not held:
        return None
    schema = StructType.fromJson(json.loads(max(held, key=lambda h: h["change"])["columns"]))
    paths = [h["path"] for h in held if h["path"] is not None]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, root: str) -> DataFrame:
    """The table as of its latest change."""
    out = _read(spark, manifest(spark, root).collect())
    if out is None:
        raise FileNotFoundError(f"there is no table at {root}")
    return out


def merge(changes: DataFrame, root: str, column: str, merged: Callable[[DataFrame | None, DataFrame], DataFrame], batch: str | None = None, touched: DataFrame | None = None, buckets: int = BUCKETS) -> bool:
    """Change the table at ``root``: ``merged(current, changes)`` over the buckets that ``changes`` touches, by ``column``.

    ``current`` has only these buckets' rows, and is None if they have none, so ``merged`` must decide each key by itself. ``touched`` (with ``column``)
    names further keys whose buckets take part, such as locations that lose all rows. ``buckets`` counts when the table is new. False
    if ``batch`` has been merged before.
    """
    spark = changes.sparkSession
    held = _latest(_notes(spark, root), F.count_if(F.col("batch") == batch) if batch is not None else F.lit(0)).collect()
    if any(h["seen"] for h in held):
        return False
    buckets, change = max(((h["buckets"], h["change"]) for h in held), key=lambda x: x[1], default=(buckets, 0))
    changes = changes.repartition(column).persist()  # dealt anew, as a cache can't carry every order that a plan may say it has
    try:
        keys = changes.select(column) if touched is None else changes.select(column).unionByName(touched.select(column))
        own = {r[0] for r in keys.select(bucket_of(column, buckets).alias("b")).distinct().collect()}  # at most ``buckets``
        if not own:
            return True
        rows = merged(_read(spark, [h for h in held if h["bucket"] in own]), changes)
        folder, written = f"{root}/data/{uuid.uuid4().hex}", Observation()
        dealt = rows.withColumn(BUCKET, bucket_of(column, buckets)).observe(written, F.collect_set(BUCKET).alias("buckets"))
        dealt.repartition(BUCKET).write.partitionBy(BUCKET).parquet(folder)
        left = set(written.get["buckets"])
    finally:
        changes.unpersist()
    if not left <= own:
        raise ValueError("a merge must not make rows of buckets that its changes don't touch")
    noted = [(change + 1, batch, buckets, b, f"{folder}/{BUCKET}={b}" if b in left else None, rows.schema.json()) for b in sorted(own)]
    spark.createDataFrame(noted, NOTE).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return True
