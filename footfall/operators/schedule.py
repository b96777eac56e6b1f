"""Schedule grids (a row for each slot, a column for each month) to service records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.config import MONTHS
from footfall.functions.calendar import nth_weekday
from footfall.functions.values import slot_nth, slot_weekday, stripped, whole_or_null


def parse_grid(grid: DataFrame) -> DataFrame:
    """source_id, service_date, visitors, year, month, slot, team, row_idx.

    Only sheets named by digits count, and of each only the rows above the first
    ``totals``; rows whose slot can't be read, cells that are no number and days that the
    month doesn't have are left out.
    """
    sheet = Window.partitionBy("source_id", "year")
    totals = F.min(F.when(F.lower(stripped(F.col("slot"))) == "totals", F.col("row_idx"))).over(sheet)
    rows = grid.filter(F.col("year").rlike("^[0-9]+$")).withColumn("__end", totals)
    rows = rows.filter(F.col("__end").isNull() | (F.col("row_idx") < F.col("__end")))
    rows = rows.withColumns({"__nth": slot_nth(F.col("slot")), "__weekday": slot_weekday(F.col("slot"))}).filter(F.col("__nth").isNotNull())
    each = F.array(*[F.struct(F.lit(i + 1).alias("month"), F.col(m).alias("cell")) for i, m in enumerate(MONTHS)])
    cells = rows.select("source_id", "year", "row_idx", "slot", "team", "__nth", "__weekday", F.inline(each).alias("__month", "__cell"))
    month, year = F.col("__month"), F.col("year").cast("int")
    return cells.select(
        "source_id",
        nth_weekday(year, month, F.col("__weekday"), F.col("__nth")).alias("service_date"),
        whole_or_null(F.col("__cell")).alias("visitors"),
        year.alias("year"),
        month.alias("month"),
        "slot",
        F.coalesce("team", F.lit("")).alias("team"),
        "row_idx",
    ).filter(F.col("service_date").isNotNull() & F.col("visitors").isNotNull())


def clean_records(records: DataFrame) -> DataFrame:
    """The last record of each (source, date, slot) in the order year, row, month; then only those above 0."""
    last = Window.partitionBy("source_id", "service_date", "slot").orderBy(F.desc("year"), F.desc("row_idx"), F.desc("month"))
    kept = records.withColumn("__n", F.row_number().over(last)).filter((F.col("__n") == 1) & (F.col("visitors") > 0))
    return kept.drop("__n", "row_idx")
