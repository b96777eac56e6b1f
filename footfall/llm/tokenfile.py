"""Token ids in files of compressed, independently coded blocks.

A file is Parquet as the container, so that any store Spark writes to can hold it and a
lost task leaves nothing behind; a row is one block: the number of its file, its place there,
how many ids of the file come before it, and the block itself. A block starts with its table of
documents (id and number of ids of each), packed by zlib, and holds their ids as coded by ``coder``.
Documents stand in ascending order of doc_id (nulls first, equal ids by their text), files in order
of their numbers. A document is never cut: one longer than a block has a block to itself.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.llm.coder import decode_block, encode_block
from footfall.llm.common import shuffle_width, texts_for_python
from footfall.llm.tokens import chunks, default_tokenizer, encoder

#: Ids after which a block is closed.
BLOCK_IDS = 4 << 20
TABLE = struct.Struct("<II")
NULL_ID = -(1 << 63)
SCHEMA = "file int, place int, before long, n_ids long, block binary"


def pack_block(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    table = zlib.compress(np.concatenate([np.diff(doc_ids, prepend=0), sizes]).astype("<i8").tobytes())
    return TABLE.pack(len(doc_ids), len(table)) + table + encode_block(ids)


def unpack_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, size = TABLE.unpack_from(block)
    table = np.frombuffer(zlib.decompress(block[TABLE.size : TABLE.size + size]), "<i8")
    return np.cumsum(table[:n]), table[n:], decode_block(block[TABLE.size + size :])


def write_token_files(documents: DataFrame, path: str, end_id: int = 2, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of every whole text, each followed by ``end_id``, to token files in ``path``. A null text is empty."""
    source = tokenizer or default_tokenizer()
    docs = texts_for_python(documents, F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = docs.repartitionByRange(shuffle_width(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, file = encoder(source), TaskContext.get().partitionId()
        names: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held: list[np.ndarray] = []
        waiting = place = before = 0

        def close() -> pa.RecordBatch:
            nonlocal waiting, place, before
            block = pack_block(np.concatenate(names), np.concatenate(sizes), np.concatenate(held))
            row = pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([place], pa.int32()), pa.array([before]), pa.array([waiting]), pa.array([block], pa.binary())], ["file", "place", "before", "n_ids", "block"])
            before, place, waiting = before + waiting, place + 1, 0
            names.clear(), sizes.clear(), held.clear()
            return row

        for batch in batches:
            keys = batch.column(0).fill_null(NULL_ID).to_numpy()
            for a, b in chunks(batch.column(1)):
                ids, at = own.encode(batch.column(1).slice(a, b - a))
                ids, at = np.insert(ids, at[1:], np.uint32(end_id)), at + np.arange(len(at))
                while a < b:  # whole documents, up to a block's worth
                    n = max(1, int(np.searchsorted(at - at[0], block_ids - waiting, "right")) - 1)
                    n = min(n, b - a)
                    names.append(keys[a : a + n]), sizes.append(np.diff(at[: n + 1])), held.append(ids[at[0] : at[n]])
                    waiting += int(at[n] - at[0])
                    a, at = a + n, at[n:]
                    if waiting >= block_ids or a < b:
                        yield close()
        if names:
            yield close()

    dealt.mapInArrow(blocks, SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (little-endian 32-bit) from token files.

    Blocks are decoded in parallel, each by itself, and their checksums verified.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    totals = files.groupBy("file").agg(F.sum("n_ids").alias("n"))
    starts = totals.select(F.col("file").alias("__file"), F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))  # a row for each file
    placed = files.join(F.broadcast(starts), F.col("file") == F.col("__file")).select((F.col("__start") + F.col("before")).alias("start"), "block")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids, sizes, ids = unpack_block(block.as_py())
                at = np.concatenate([[0], np.cumsum(sizes)])
                packed = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(ids)])
                names = pa.array(doc_ids, mask=doc_ids == NULL_ID)
                yield pa.RecordBatch.from_arrays([names, pa.array(start + at[:-1]), pa.array(sizes), packed], ["doc_id", "start", "n_tokens", "ids"])

    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")
