"""Near-duplicates by SimHash fingerprints, found through Golay-code fuzzy hashing.

Fingerprints link at 3 or fewer differing bits. They are cut into segments of 23, 23 and 18
bits, and the errors of a link fall on them in one of two ways:
  a segment is free of errors, and one of the other two has at most 1: the key is the first
  segment as it is with a codeword near the second (6 kinds of keys, 30 bits or more);
  each segment has 1: the key is a codeword near each (36 bits).
The codewords that a segment and its one-bit neighbours decode to are at most 6, and at
distance 1 either segment's own codeword is among the other's; so one side of the join
gives several keys and the other its own. A pair is taken only at the one kind of key
that its differing bits call for, and once, so the join returns each link exactly once,
verified. Equal fingerprints are one vertex from the start.

Components are found by large-star and small-star rounds on the links; every round is
written to the shared folder. Nothing is capped; copies are never paired with one another.

A null or wordless text has fingerprint 0 and links like any other. Rows with a null doc_id
belong to their component without naming it. Repeated rows stay. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import materialize, texts_for_python
from footfall.llm.golay import nearby, nearest

#: Places of the segments: lowest bit and width.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Kinds of keys: the segment that is exact, and the one that is near; the last kind is near in all three.
KINDS = tuple((k, i) for k in range(3) for i in range(3) if i != k)
SHINGLE, SEED, LINK_BITS = 3, 42, 3
#: Fingerprints that are broadcast at most: each is shared by more than one in so many rows.
HOT_CLASSES = 1000
#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 16
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: bytes, words: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of a text's shingles: a bit is 1 if over half the shingles' XXH64 have it."""
    from xxhash import xxh64_intdigest

    own = text.translate(_LOWER).split()
    if not own:
        return 0
    if len(own) <= words:
        return xxh64_intdigest(b" ".join(own), seed)
    line, ends = b" ".join(own), np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.concatenate([[0], ends[: -words] + 1])
    counts, n = np.zeros(64, np.int64), len(starts)
    for a in range(0, n, AT_ONCE):
        pieces = zip(starts[a : a + AT_ONCE].tolist(), ends[words - 1 :][a : a + AT_ONCE].tolist())
        hashes = np.array([xxh64_intdigest(line[i:j], seed) for i, j in pieces], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp: the fingerprint's 64 bits as a long. A null text is the empty one, whose fingerprint is 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fps = np.array([fingerprint(t.as_buffer().to_pybytes()) for t in texts], np.uint64) if len(texts) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    source = texts_for_python(documents, F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return source.mapInArrow(work, "doc_id long, fp long")


def _keys(many: bool):
    """A mapInArrow function: fp to its keys, several for each near segment (``many``) or its own codeword."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            cut = [((fps.view(np.uint64) >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
            own = [nearest(c)[:, None] for c in cut]
            near = [nearby(c, width) for c, (_, width) in zip(cut, SEGMENTS, strict=True)]
            rows, keys = [], []

            def add(kind: int, key: np.ndarray) -> None:
                flat = (kind << 59) | key.reshape(len(fps), -1)
                flat.sort(1)
                fresh = np.ones(flat.shape, bool)
                fresh[:, 1:] = flat[:, 1:] != flat[:, :-1]
                rows.append(np.nonzero(fresh)[0])
                keys.append(flat[fresh])

            for kind, (exact, close) in enumerate(KINDS):
                add(kind, (cut[exact][:, None] << 12) | (near if many else own)[close])
            a, b, c = (near[0], own[1], near[2]) if many else (own[0], near[1], own[2])
            add(len(KINDS), (a[:, :, None, None] << 24) | (b[:, None, :, None] << 12) | c[:, None, None, :])
            row, key = np.concatenate(rows), np.concatenate(keys)
            for i in range(0, len(row), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(key[i : i + (1 << 18)]), pa.array(fps[row[i : i + (1 << 18)]])], ["key", "fp"])

    return work


def _kind(differing: Column) -> Column:
    """The one kind of key at which a pair with these differing bits is taken."""
    errors = [F.bit_count(F.shiftrightunsigned(differing, at).bitwiseAND(F.lit((1 << width) - 1))) for at, width in SEGMENTS]
    out = F.lit(len(KINDS))
    for kind, (exact, close) in reversed(list(enumerate(KINDS))):
        out = F.when((errors[exact] == 0) & (errors[close] <= 1), kind).otherwise(out)
    return out


def links(fps: DataFrame) -> DataFrame:
    """a, b: every pair of different fingerprints (column fp, distinct) at most 3 bits apart, once, a below b."""
    left = fps.select("fp").mapInArrow(_keys(True), "key long, fp long").withColumnRenamed("fp", "a")
    right = fps.select("fp").mapInArrow(_keys(False), "key long, fp long").select("key", F.col("fp").alias("b"))
    differing = F.col("a").bitwiseXOR(F.col("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(differing) <= LINK_BITS)
    taken = near & (_kind(differing) == F.shiftright(left["key"], 59))
    return left.join(right, (left["key"] == right["key"]) & taken).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each component, for every node of the undirected edges (a, b).

    Each round points nodes at the least neighbour: first those above a node (large star),
    then those below it (small star). The edges end as stars round each component's root.
    """
    own = F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")
    stars = materialize(edges.select(*own).filter(F.col("low") < F.col("high")).distinct(), "components")
    before = None
    while True:
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if now == before:
            return stars.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(stars.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())
        before = now
        both = stars.select(F.col("low").alias("at"), F.col("high").alias("to")).unionByName(stars.select(F.col("high").alias("at"), F.col("low").alias("to")))
        least = both.groupBy("at").agg(F.least(F.min("to"), F.col("at")).alias("root"))
        large = both.filter(F.col("to") > F.col("at")).join(least, "at").select(F.col("root").alias("low"), F.col("to").alias("high")).distinct()
        large = materialize(large, "components")
        down = large.select(F.col("high").alias("at"), F.col("low").alias("to"))
        least = down.groupBy("at").agg(F.min("to").alias("root"))
        small = down.join(least, "at").select(F.col("root").alias("low"), F.col("to").alias("high")).filter(F.col("low") < F.col("high"))
        small = small.unionByName(least.select(F.col("root").alias("low"), F.col("at").alias("high")))
        stars = materialize(small.distinct(), "components")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id, the least doc_id of those reachable through links, for every row."""
    fps = materialize(fingerprints(documents, id_col, text_col), "simhash")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    roots = materialize(components(links(classes)), "simhash-roots")
    named = classes.join(roots, F.col("fp") == F.col("node"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    moved = named.join(least, "root").select("fp", "component_id")  # only classes with links
    whole = materialize(classes.join(moved, "fp", "left").select("fp", "n", F.coalesce("component_id", "first").alias("component_id")), "simhash-whole")
    # copies of one text all have its fingerprint: those of over a share of all rows are few, and their rows are never gathered
    most = (classes.agg(F.sum("n")).first()[0] or 0) / HOT_CLASSES
    hot, rest = whole.filter(F.col("n") > most).drop("n"), whole.filter(F.col("n") <= most).drop("n")
    of_hot = fps.join(F.broadcast(hot), "fp")
    of_rest = fps.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(rest, "fp")
    return of_hot.unionByName(of_rest).select("doc_id", "fp", "component_id")
