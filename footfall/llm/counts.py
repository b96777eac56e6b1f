"""Token counts of documents from flat, unindexed token files, by a scan for separators.

A flat file is nothing but ids of one width, with an end-of-document id after each
document. Its blocks are searched for that id with array operations, each by itself, without
knowing where a document starts; a block says how many ends it has, how many ids stand before the
first and after the last, and how long the documents are that lie wholly inside. Prefix sums
over the blocks of a part, then over the parts, stitch documents that cross boundaries together.

The task that writes a part cuts it into files of a bounded number of bytes, and writes the ids of the documents beside each, in
the same order: which count belongs to which document doesn't depend on reading the documents again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.llm.common import materialize
from footfall.llm.tokens import default_tokenizer, encoded, texts_to_encode

#: Ids in a block, and those of a flat file: big-endian 16 bits, with an end of document
#: that no vocabulary of fewer ids has. As text, those two bytes are the character U+07FF.
BLOCK_IDS, ID_TYPE, END_ID = 1 << 18, ">u2", 0xDFBF
#: Bytes that neither a flat file nor the list beside it exceeds, so that each is a row that fits into memory when it is read; a longer document has files by itself.
FILE_BYTES = 64 << 20
#: Folders of the two kinds of files.
FLAT, NAMES = 0, 1


def write_flat(documents: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", id_type: str = ID_TYPE, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> None:
    """Write the ids of every whole text and an end of document after each to flat files in ``path``, and the documents' ids beside them.

    The end is what Spark's text writer puts after each line, so its bytes must be UTF-8: a choice of ``end_id``
    for the ``id_type``. A task writes its own partition of ``documents``, as it comes; nothing is shuffled.
    """
    end = np.array([end_id], id_type).tobytes().decode()  # UnicodeDecodeError: choose another
    end_bytes = len(end.encode())
    source = tokenizer or default_tokenizer()

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, held, place = 0, 0, 0
        names: list[str] = []

        def rows(kind: int, values: pa.Array) -> pa.RecordBatch:
            nonlocal place
            n = len(values)
            own = [pa.array(np.full(n, x, np.int32)) for x in (kind, piece)]
            place += n
            return pa.RecordBatch.from_arrays([*own, pa.array(np.arange(place - n, place)), values], ["kind", "piece", "place", "value"])

        for batch in encoded(batches, source, None, id_type, end_id):
            ids, own = batch.column(2), ["" if x is None else str(x) for x in batch.column(0).to_pylist()]
            flat = np.diff(np.frombuffer(ids.buffers()[1], np.int32)[: len(ids) + 1]).astype(np.int64) + end_bytes
            # what a document takes of either file: its ids and their end, or its name and a comma
            until = np.cumsum(np.maximum(flat, np.fromiter(map(len, own), np.int64, len(own)) + 1))
            a = 0
            while a < len(ids):
                before = int(until[a - 1]) if a else 0
                b = int(np.searchsorted(until, before + file_bytes - held, "right"))
                if b == a and not names:
                    b = a + 1
                if b > a:
                    yield rows(FLAT, ids.slice(a, b - a))
                    names += own[a:b]
                    held += int(until[b - 1]) - before
                if b < len(ids):
                    if names:
                        yield rows(NAMES, pa.array([",".join(names).encode()], pa.binary()))
                    piece, held = piece + 1, 0
                    names.clear()
                a = b
        if names:
            yield rows(NAMES, pa.array([",".join(names).encode()], pa.binary()))

    out = texts_to_encode(documents, id_col, text_col).mapInArrow(lines, "kind int, piece int, place long, value binary")
    ordered = out.select("kind", "piece", "place", F.col("value").cast("string").alias("value")).sortWithinPartitions("kind", "piece", "place")
    ordered.drop("place").write.partitionBy("kind", "piece").option("lineSep", end).text(path)


def _files(spark: SparkSession, path: str, kind: int) -> DataFrame:
    """part (number of the task that wrote it), piece and content of each file of a kind."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    if "kind" not in files.columns:  # no documents, no folders
        files = files.withColumns({"kind": F.lit(kind), "piece": F.lit(0)})
    return files.filter(F.col("kind") == kind).select(F.regexp_extract("path", r"/part-(\d+)-[^/]*$", 1).cast("int").alias("part"), F.col("piece").cast("long").alias("piece"), "content")


def scan_blocks(spark: SparkSession, path: str, id_type: str = ID_TYPE, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """part, block, ends, head, tail and inner: what each block of each flat file in ``path`` says by itself.

    Blocks of a part are numbered through its files, with gaps.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, first, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = np.frombuffer(content.as_buffer(), id_type)
                for k in range(-(-len(ids) // block_ids)):
                    block = ids[k * block_ids : (k + 1) * block_ids]
                    ends = np.flatnonzero(block == end_id)
                    n, some = len(ends), len(ends) > 0
                    head = int(ends[0]) if some else 0
                    tail = len(block) - 1 - int(ends[-1]) if some else len(block)
                    inner = np.diff(ends) - 1
                    yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([(first << 32) + k]), pa.array([n]), pa.array([head]), pa.array([tail]), pa.array([inner], pa.list_(pa.int64()))], ["part", "block", "ends", "head", "tail", "inner"])

    return _files(spark, path, FLAT).mapInArrow(scan, "part int, block long, ends long, head long, tail long, inner array<long>")


def _carried(pieces: DataFrame, within: list[str], order: str) -> DataFrame:
    """Add before (ends so far) and carry (ids since the last end) of each piece, from the pieces before it."""
    line = Window.partitionBy(*within).orderBy(order) if within else Window.orderBy(order)
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    run = pieces.withColumn("__ends", F.sum("ends").over(so_far)).withColumn("__run", F.sum((F.col("ends") > 0).cast("int")).over(so_far))
    since = Window.partitionBy(*within, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = run.withColumn("__open", F.sum("tail").over(since))
    return run.withColumn("before", F.col("__ends") - F.col("ends")).withColumn("carry", F.coalesce(F.lag("__open").over(line), F.lit(0))).drop("__run")


def stitch(blocks: DataFrame) -> DataFrame:
    """part, nth and n_tokens of every document: the nth (from 0) that ends in that part.

    A document that began in an earlier part counts where it ends; ids after the last end of all
    are a document that has not ended, in part null. Parts stand in the order of their numbers.
    """
    inside = _carried(blocks, ["part"], "block")
    parts = inside.groupBy("part").agg(F.sum("ends").alias("ends"), F.max_by("__open", "block").alias("tail"))
    parts = _carried(parts, [], "part")  # a row for each file
    carries = parts.select("part", F.col("carry").alias("part_carry"))
    first = F.col("carry") + F.col("head") + F.when(F.col("before") == 0, F.col("part_carry")).otherwise(0)
    ended = inside.filter(F.col("ends") > 0).join(carries, "part").select("part", "before", F.posexplode(F.concat(F.array(first), F.col("inner"))).alias("k", "n_tokens"))
    left = parts.select(F.max_by("__open", "part").alias("n_tokens")).filter(F.col("n_tokens") > 0)
    return ended.select("part", (F.col("before") + F.col("k")).alias("nth"), "n_tokens").unionByName(left.select(F.lit(None).cast("int").alias("part"), F.lit(0).cast("long").alias("nth"), "n_tokens"))


def positions(spark: SparkSession, path: str, end_id: int = END_ID, id_type: str = ID_TYPE) -> DataFrame:
    """part, nth and doc_id: the documents in the order in which ``write_flat`` put them, from the lists beside the files."""
    end = np.array([end_id], id_type).tobytes().decode()
    lists = _files(spark, path, NAMES).select("part", "piece", F.split(F.rtrim(F.col("content").cast("string"), F.lit(end)), ",", -1).alias("names"))
    before = Window.partitionBy("part").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    placed = lists.withColumn("first", F.coalesce(F.sum(F.size("names")).over(before), F.lit(0)))
    named = placed.select("part", "first", F.posexplode("names").alias("at", "name"))
    return named.select("part", (F.col("first") + F.col("at")).alias("nth"), F.when(F.col("name") != "", F.col("name").cast("long")).alias("doc_id"))


def token_counts(spark: SparkSession, path: str, **file: object) -> DataFrame:
    """doc_id, part, nth, n_tokens from the flat files in ``path`` that ``write_flat`` made.

    Nulls, repeated rows and empty texts count like any others; a document that the lists or the files lack is an error.
    """
    counted = stitch(materialize(scan_blocks(spark, path, **file), "token-blocks"))
    both = positions(spark, path).join(counted, ["part", "nth"], "full")
    return both.select("doc_id", "part", "nth", F.when(F.col("part").isNull() | F.col("n_tokens").isNull(), F.raise_error(F.lit("the lists are not those of these files")).cast("long")).otherwise(F.col("n_tokens")).alias("n_tokens"))
