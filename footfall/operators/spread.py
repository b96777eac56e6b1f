"""Groups of unlike cost over tasks.

Spark sizes the tasks after a shuffle by bytes; a group of a few kilobytes that takes minutes to compute needs another measure.
Here groups are ranked by what they are estimated to cost and dealt round and back over a stated number of
partitions, so each gets as many dear and as many cheap ones as any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Parts that the groups of about one cost are ranked in.
SALTS = 32
#: Cost classes in a doubling of the cost.
CLASSES = 4
#: Partitions for each task that can run at once, by default.
ROUNDS = 4

PART = "__part"


def parts_for(spark: SparkSession) -> int:
    """Partitions for groups whose cost is not in their bytes: several rounds of all tasks."""
    return ROUNDS * max(1, spark.sparkContext.defaultParallelism)


def dealt(groups: DataFrame, keys: list[str], cost: str, parts: int) -> DataFrame:
    """``groups`` (a row each) with ``PART``, from 0 to ``parts`` - 1, dealt by falling ``cost``.

    Ranks come from classes of cost and parts of these, whose sizes are added up: at most some
    thousand rows in one task, however many groups there are.
    """
    size = F.greatest(F.col(cost).cast("double"), F.lit(1.0))
    ranked = groups.withColumns({"__class": -F.floor(F.log2(size) * CLASSES), "__salt": F.pmod(F.xxhash64(*keys), F.lit(SALTS))})
    sizes = ranked.groupBy("__class", "__salt").agg(F.count(F.lit(1)).alias("__held"))
    before = Window.partitionBy(F.lit(0)).orderBy("__class", "__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__class", "__salt", F.coalesce(F.sum("__held").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__class", "__salt").orderBy(F.desc(cost), *keys)) - 1
    turn = F.pmod(F.col("__start") + F.col("__in"), F.lit(2 * parts))
    placed = ranked.withColumn("__in", inside).join(starts, ["__class", "__salt"])
    return placed.withColumn(PART, F.least(turn, 2 * parts - 1 - turn).cast("int")).drop("__class", "__salt", "__in", "__start")


def apply_groups(rows: DataFrame, keys: list[str], function: Callable[[tuple, pd.DataFrame], pd.DataFrame], schema: str, parts: int) -> DataFrame:
    """``function(key, group)`` for each group of ``rows``, in the partition that ``PART`` says; a task holds one group at a time."""
    sent = rows.repartitionById(parts, F.col(PART)).sortWithinPartitions(*keys).drop(PART)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for batch in batches:
            for key, group in batch.groupby(keys, sort=False, dropna=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                if held and key != now:
                    yield function(now, pd.concat(held, ignore_index=True))
                    held = []
                now = key
                held.append(group)
        if held:
            yield function(now, pd.concat(held, ignore_index=True))

    return sent.mapInPandas(run, schema)
