"""Quantiles of everything before a row, for every row of a growing history.

The values of a group are ranked once. A wavelet matrix of the ranks, in the order of the rows, holds for each bit of a
rank how many of the first rows have it clear; the k-th smallest of any prefix follows from one look-up a bit. All rows go down the
bits together, so a group of n rows costs n log n array steps, where a window over a growing frame sorts its frame for each row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType


def running_quantiles(values: np.ndarray, quantile: float) -> np.ndarray:
    """For each place the linear quantile of the values before it that are no NaN; NaN where there are none."""
    known = ~np.isnan(values)
    before = np.cumsum(known) - known
    v = values[known]
    if not len(v):
        return np.full(len(values), np.nan)
    order = np.argsort(v, kind="stable")
    rank = np.empty(len(v), np.int64)
    rank[order] = np.arange(len(v))
    levels, seq = [], rank
    for bit in range(max(1, (len(v) - 1).bit_length()) - 1, -1, -1):
        high = (seq >> bit & 1).astype(bool)
        levels.append((bit, np.append(0, np.cumsum(~high))))
        seq = np.concatenate([seq[~high], seq[high]])

    def kth(k: np.ndarray) -> np.ndarray:
        begin, end, found = np.zeros(len(k), np.int64), before.copy(), np.zeros(len(k), np.int64)
        for bit, clear in levels:
            a, b = clear[begin], clear[end]
            low = k < b - a
            begin, end = np.where(low, a, clear[-1] + begin - a), np.where(low, b, clear[-1] + end - b)
            k, found = np.where(low, k, k - (b - a)), found | np.where(low, 0, 1 << bit)
        return v[order][np.minimum(found, len(v) - 1)]

    place = quantile * np.maximum(before - 1, 0)
    floor = np.floor(place).astype(np.int64)
    lower, upper = kth(floor), kth(np.minimum(floor + 1, np.maximum(before - 1, 0)))
    return np.where(before > 0, lower + (place - floor) * (upper - lower), np.nan)


def with_running_quantiles(df: DataFrame, keys: list[str], order: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Add for each name in ``wanted`` the quantile (column, share) of the rows of the group before, by ``order``; null where none has a value.

    Orders of a group are distinct. All columns stay as they are.
    """
    schema = StructType([*df.schema.fields, *(StructField(name, DoubleType()) for name in wanted)])

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by([(order, "ascending")])
        for name, (column, share) in wanted.items():
            values = table.column(column).cast(pa.float64()).to_numpy()
            table = table.append_column(name, pa.array(running_quantiles(values, share), pa.float64(), from_pandas=True))
        return table

    return df.groupBy(*keys).applyInArrow(add, schema)
