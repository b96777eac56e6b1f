"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character as it is, in any locale."""
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder of its own; on a
    cluster that is an error, because executors would not see one another's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a scan of it.

    It cuts the lineage, and a lost executor costs the tasks it ran, not the result.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: The columns of ``numbered``: a number for each row, and the row.
ROW, KEPT = "row_number", "kept"


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, each as one column, with a number of its own, written once so that every reader sees the same numbers."""
    return materialize(df.select(F.monotonically_increasing_id().alias(ROW), F.struct(*df.columns).alias(KEPT)), name)


#: Row numbers that ``without`` broadcasts at most: some hundred MB of memory.
FEW_ROWS = 4_000_000


def without(rows: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """``numbered`` rows as they were, but for those whose numbers (distinct, one column) are ``gone``.

    Up to ``FEW_ROWS`` numbers go to the rows, whole texts are not shuffled for them; more are joined by a shuffle.
    """
    gone = materialize(gone.select(F.col(gone.columns[0]).alias("__gone")), name)
    side = F.broadcast(gone) if gone.count() <= FEW_ROWS else gone
    return rows.join(side, F.col(ROW) == F.col("__gone"), "left_anti").select(f"{KEPT}.*")


#: Texts in an Arrow batch at most: batches of whole texts are held several times over, in the JVM and in Python.
TEXTS_IN_BATCH = 1000


def texts_for_python(documents: DataFrame, *columns: Column) -> DataFrame:
    """Columns that a Python function will read, in batches small enough for long texts."""
    conf, name = documents.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= TEXTS_IN_BATCH:
        conf.set(name, str(TEXTS_IN_BATCH))
    return documents.select(*columns)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dense_rank_in_groups(df: DataFrame, groups: list[str], order: list[str], to: str, salts: int = 64) -> DataFrame:
    """Number the rows of each group from 0 without holes, in ``to``.

    A group may hold most of the rows, so it is cut by ``md5(order[0])`` into
    ``salts`` parts that are numbered apart; each part starts where those before it
    end. The order is (part, ``order``); equal rows get neighbouring numbers in any order.
    """
    part = F.conv(F.substring(F.md5(F.coalesce(F.col(order[0]).cast("string"), F.lit(""))), 1, 6), 16, 10).cast("long") % salts
    parts = df.withColumn("__part", part)
    keys = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*groups, "_part"] if c != "_part"]
    sizes = parts.groupBy(*groups, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(c).alias(f"__{c}") for c in groups], F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    numbered = parts.withColumn("__at", F.row_number().over(Window.partitionBy(*groups, "__part").orderBy(*order)))
    on = (F.col("__part") == F.col("__p"))
    for k in keys:
        on = on & k
    return numbered.join(starts, on).withColumn(to, F.col("__start") + F.col("__at") - 1).select(*df.columns, to)
