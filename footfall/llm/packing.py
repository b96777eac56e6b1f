"""Best-fit decreasing packing of documents into sequences of fixed capacity.

Best-fit decreasing takes the longest piece first and puts it into the tightest open
sequence that has room. Pieces of one length are alike, and so are sequences with
one remaining capacity, so the whole run is a function of how many pieces there are of each
length: it is computed exactly from that histogram, moving runs of like sequences at
once, with a segment tree over remaining capacities that finds the tightest in
logarithmic time. The histogram has at most ``capacity`` rows and the plan is bounded by
the capacity alone, whatever the number of documents. Pieces then look their places up
by length and rank, in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import dense_rank_in_groups, materialize, shuffle_width


class CapacityTree:
    """Which remaining capacities have open sequences; finds the least that is at least so large."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.width)

    def add(self, capacity: int, n: int) -> None:
        at = self.width + capacity
        while at:
            self.open[at] += n
            at //= 2

    def tightest(self, least: int) -> int | None:
        at = self.width + least
        if self.open[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.width
            at //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, pieces, first sequence, pieces in each sequence, offset), by length and rank.

    The pieces of a length with ranks from the first on go ``k`` by ``k`` into the sequences
    from the first on, starting at the offset.
    """
    tree = CapacityTree(capacity)
    runs: dict[int, list[tuple[int, int]]] = {}
    plan, sequences = [], 0

    def put(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            runs.setdefault(remaining, []).append((first, n))
            tree.add(remaining, 1)

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} doesn't fit into {capacity}")
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            else:
                first, n = runs[room].pop()
                tree.add(room, -1)
            each = min(room // length, left)
            full = min(n, left // each)
            plan.append((length, rank, full * each, first, each, capacity - room))
            put(room - each * length, first, full)
            rank, left = rank + full * each, left - full * each
            if full < n:
                put(room, first + full, n - full)
    return np.array(sorted(plan), np.int64).reshape(-1, 6)


def pieces(tokens: DataFrame, capacity: int = 4096) -> DataFrame:
    """Cut documents of more than ``capacity`` ids; doc_id, piece, start, length, ids. A document without ids has no piece."""
    cut = tokens.filter(F.col("n_tokens") > 0).select("doc_id", "ids", "n_tokens", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity).cast("int"))).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    length = F.least(F.lit(capacity), F.col("n_tokens") - start)
    return cut.select("doc_id", "piece", start.alias("start"), length.cast("long").alias("length"), F.substring(F.col("ids"), start.cast("int") * 4 + 1, length.cast("int") * 4).alias("ids"))


def pack(items: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add sequence_id and offset to rows with doc_id, piece and length (1 to ``capacity``).

    Every row is placed once; a sequence's offsets have no gaps. Equal rows get places of
    their own. An empty table gives an empty one. Nulls in doc_id are ordinary ids.
    """
    stored = materialize(items, "packing-items")
    counts = {int(r["length"]): int(r["n"]) for r in stored.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    plan = best_fit_plan(counts, capacity)
    keys = (plan[:, 0] << 40) + plan[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = plan[np.searchsorted(keys, (length << 40) + rank, "right") - 1]
            nth = rank - row[:, 1]
            columns = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "rank"]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(row[:, 3] + nth // row[:, 4]), pa.array(row[:, 5] + nth % row[:, 4] * length)], [*names, "sequence_id", "offset"])

    ranked = dense_rank_in_groups(stored, ["length"], ["doc_id", "piece"], "rank", max(64, shuffle_width(items.sparkSession)))
    schema = ", ".join(f"`{n}` {t}" for n, t in stored.dtypes)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")
