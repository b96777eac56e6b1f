"""Prefix trie of conversations, built as a distributed burst trie.

A conversation is a sequence of turns; each distinct prefix is a node, below the root, which has no turn. Equal
conversations are counted first, so a conversation that half the table repeats is one sequence. All sequences
start in one container under the root. A container of more than ``limit`` sequences is burst: the turns that all of
them share become trie nodes in one step, and its sequences go into containers by their next turn, each under the
trie head so made. Rounds go on until no container is too large. The containers left are dealt over the
tasks, sorted, and swept: neighbours' common prefixes say which nodes open and close, so a task holds one path of nodes. The
containers' totals are then added up along the trie heads, which are few: a head has more than ``limit`` sequences below it.

A turn's id is the first half of the SHA-256 of its role and text, so texts are read once and never shuffled. One
conversation is one row of ids (16 bytes a turn); nothing else is ever gathered into a row: the ids of the
conversations that end at a node are hashed as a stream of sorted pieces.

Order and edges: turns go by ``turn`` (null first), then role, then turn id, so equal rows are equal turns that count as often as they
are there. A null role or text is an empty one. Rows without conv_id are of no conversation and are left out. An empty table gives
no node. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import WORD, materialize

#: Sequences that a container holds at most: a share of all, within these bounds.
LEAST_LIMIT, MOST_LIMIT, SHARE = 256, 65_536, 1024
#: Bits of a conversation id that tell ids of one piece of the text that ends_sha256 is taken of.
PIECE_BITS = 10
#: Heads that are broadcast; more of them are shuffled.
FEW = 100_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
#: Output rows of a sweep in one Arrow batch.
ROWS_OUT = 20_000

NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turn_id(role: Column, text: Column) -> Column:
    """What turns of one role and text share: 16 bytes."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))


def _digest(ids: Column) -> Column:
    """16 bytes that stand for an array of turn ids."""
    return F.unhex(F.substring(F.sha2(F.array_join(F.transform(ids, F.hex), "").cast("binary"), 256), 1, 32))


def sequences(turns: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """conv_id and ``turns``, its turns in order as (id, words). ``groups`` are columns of ``turns``, of conv_id, that the rows are dealt by and that stay."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn = F.struct(F.col("turn"), role.alias("role"), turn_id(role, text).alias("id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(*(groups or []), "conv_id", turn.alias("t"))
    if groups:
        rows = rows.repartition(*groups)
    ordered = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words")))
    return rows.groupBy(*(groups or []), "conv_id").agg(ordered.alias("turns"))


def with_shared_heads(turns: DataFrame, every: int, head: Column, most: int) -> DataFrame:
    """``sequences`` rebuilt: the first ``head`` (0 to ``most``) turns of conversation conv_id - conv_id % ``every``, then the own turns after as many."""
    rows = turns.select("conv_id", "turn", "role", "text", (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    own = sequences(rows, ["base"])
    heads = sequences(rows.filter(F.col("conv_id") % every == 0), ["base"]).select("base", F.slice("turns", 1, most).alias("__head"))
    rebuilt = F.concat(F.slice(F.coalesce("__head", F.slice("turns", 1, 0)), F.lit(1), head), F.slice("turns", head + 1, F.size("turns")))
    return own.join(heads, "base", "left").select("conv_id", rebuilt.alias("turns"))


def _ends(named: DataFrame) -> DataFrame:
    """name, ends_sha256: SHA-256 of the conv_ids of each name, ascending and comma-joined, for names that several have.

    Ids are joined in pieces of neighbouring values, so a name of many conversations is spread
    over the tasks; the pieces go through the digest in order, one at a time.
    """
    piece = F.shiftright("conv_id", PIECE_BITS)
    text = F.array_join(F.transform(F.array_sort(F.collect_set("conv_id")), lambda c: c.cast("string")), ",")
    pieces = named.groupBy("name", piece.alias("piece")).agg(text.alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sha, done = None, None, []
        for batch in batches:
            for own, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if own == name:
                    sha.update(b",")
                else:
                    if sha is not None:
                        done.append((name, sha.hexdigest()))
                    name, sha = own, hashlib.sha256()
                sha.update(ids.encode())
            if len(done) >= ROWS_OUT:
                yield pa.RecordBatch.from_pydict({"name": [d[0] for d in done], "ends_sha256": [d[1] for d in done]})
                done = []
        if sha is not None:
            done.append((name, sha.hexdigest()))
        if done:
            yield pa.RecordBatch.from_pydict({"name": [d[0] for d in done], "ends_sha256": [d[1] for d in done]})

    return pieces.repartition("name").sortWithinPartitions("name", "piece").select("name", "ids").mapInArrow(digest, "name binary, ends_sha256 string")


def _distinct(seqs: DataFrame) -> DataFrame:
    """The distinct sequences: conv_id (the least that has it), n, ids, words, ends_sha256."""
    ids = F.transform("turns", lambda t: t["id"])
    named = seqs.withColumn("name", _digest(ids))
    counted = named.groupBy("name").agg(F.min("conv_id").alias("__least"), F.count(F.lit(1)).alias("n"))
    counted = materialize(counted, "trie-counts")
    several = counted.filter("n > 1").select("name")
    ends = _ends(named.select("name", "conv_id").join(several, "name", "left_semi"))
    held = counted.join(ends, "name", "left").select("__least", "n", "ends_sha256")
    one = F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    return seqs.join(held, F.col("conv_id") == F.col("__least")).select("conv_id", "n", ids.alias("ids"), F.transform("turns", lambda t: t["words"]).alias("words"), F.coalesce("ends_sha256", one).alias("ends"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW else df


def _longest_common(a: Column, b: Column) -> Column:
    """How many first elements of two arrays agree."""
    both = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(0), both), lambda i: (i == both) | (F.get(a, i) != F.get(b, i)))
    return differs[0]


def _burst(seqs: DataFrame, limit: int) -> tuple[DataFrame, list[tuple[DataFrame, int]], DataFrame | None]:
    """Containers of at most ``limit`` sequences, the trie heads of each round with their number, and sequences that end at a head.

    A container is known by ``head`` (a digest of the prefix that its sequences share), ``depth`` (the turns of it)
    and ``above`` (the head it hangs under, null for the root's).
    """
    root = F.when(F.col("conv_id").isNotNull(), F.lit(b""))  # all rows', but no constant, which would leave joins by it without a key
    rest = seqs.withColumns({"head": root, "depth": F.lit(0), "above": F.lit(None).cast("binary")})
    settled, heads, ended = [], [], []
    while True:
        large = rest.groupBy("head").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > limit).select("head")
        large = materialize(large, "trie-large")
        n_large = large.count()
        if not n_large:
            settled.append(rest)
            break
        settled.append(rest.join(_small(large, n_large), "head", "left_anti"))
        full = rest.join(_small(large, n_large), "head", "left_semi")
        suffix = F.slice("ids", F.col("depth") + 1, F.size("ids"))
        ends = full.groupBy("head", "depth", "above").agg(F.min(suffix).alias("first"), F.max(suffix).alias("last"), F.min_by("words", "conv_id").alias("words"))
        shared = _longest_common(F.col("first"), F.col("last"))
        made = ends.select("head", "depth", "above", (F.col("depth") + shared).alias("fork"), F.slice("words", F.greatest(F.col("depth"), F.lit(1)), shared + F.when(F.col("depth") > 0, 1).otherwise(0)).alias("path_words"))
        made = materialize(made, "trie-heads")
        heads.append((made, n_large))
        moved = full.join(_small(made.select("head", "fork"), n_large), "head")
        stops = F.size("ids") == F.col("fork")
        ended.append(moved.filter(stops).select("conv_id", "n", "ends", F.col("head").alias("above")))
        child = _digest(F.slice("ids", F.lit(1), F.col("fork") + 1))
        on = moved.filter(~stops).select(*seqs.columns, child.alias("head"), (F.col("fork") + 1).alias("depth"), F.col("head").alias("above"))
        rest = materialize(on, "trie-containers")
    whole = settled[0]
    for part in settled[1:]:
        whole = whole.unionByName(part)
    stopped = None
    for part in ended:
        stopped = part if stopped is None else stopped.unionByName(part)
    return whole, heads, stopped


class _Open:
    """A node on the path that a sweep is at."""

    __slots__ = ("depth", "conv", "n", "children", "leaves", "saved", "ends", "words", "waiting")

    def __init__(self, depth: int, words: int):
        self.depth, self.words, self.conv, self.n, self.children, self.leaves, self.saved, self.ends, self.waiting = depth, words, None, 0, 0, 0, 0, EMPTY_SHA, []

    def take(self, conv: int, n: int) -> None:
        self.conv, self.n = conv if self.conv is None else min(self.conv, conv), self.n + n


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of containers whose sequences come sorted. A node waits for its parent to close, whose least conv_id it names; a container's top node names the head above."""
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "above", "top"]
    kinds = pa.schema([(n, pa.int32() if n == "depth" else pa.string() if n == "ends_sha256" else pa.binary() if n == "above" else pa.bool_() if n == "top" else pa.int64()) for n in names])
    out: list[tuple] = []
    path: list[_Open] = []
    head = above = ids = None

    def close() -> None:
        node = path.pop()
        node.leaves = node.leaves or 1
        node.saved += (node.n - 1) * node.words
        out.extend((*row[:2], node.conv, *row[2:], None, False) for row in node.waiting)
        row = (node.conv, node.depth, node.n, node.children, node.leaves, node.saved, node.ends)
        if path:
            up = path[-1]
            up.waiting.append(row)
            up.take(node.conv, node.n)
            up.children, up.leaves, up.saved = up.children + 1, up.leaves + node.leaves, up.saved + node.saved
        else:
            out.append((*row[:2], None, *row[2:], above, True))

    def flushed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)
        out.clear()
        return batch

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("head", "depth", "above", "ids", "words", "n", "conv_id", "ends")]
        for own, top, over, turns, words, n, conv, ends in zip(*columns, strict=True):
            if own != head:
                while path:
                    close()
                head, above, common = own, over, top
                path.append(_Open(top, words[top - 1] if top else 0))
            else:
                common, most = top, min(len(ids), len(turns))
                while common < most and ids[common] == turns[common]:
                    common += 1
            while path[-1].depth > common:
                close()
            path.extend(_Open(d, words[d - 1]) for d in range(path[-1].depth + 1, len(turns) + 1))
            path[-1].ends = ends
            path[-1].take(conv, n)
            ids = turns
            if len(out) >= ROWS_OUT:
                yield flushed()
    while path:
        close()
    if out:
        yield flushed()


def _add_up(tops: DataFrame, heads: list[tuple[DataFrame, int]], stopped: DataFrame) -> DataFrame:
    """Totals of all heads, from those of the last round up: what hangs below each, and its path's nodes."""
    below = tops.select("above", "conv_id", "n_convs", "n_leaves", "saved_tokens", F.lit(1).alias("child"), F.lit(None).cast("string").alias("ends"))
    below = below.unionByName(stopped.select("above", "conv_id", F.col("n").alias("n_convs"), F.lit(0).alias("n_leaves"), F.lit(0).alias("saved_tokens"), F.lit(0).alias("child"), "ends"))
    done = None
    for made, _ in reversed(heads):
        sums = below.groupBy(F.col("above").alias("head")).agg(
            F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below_saved"), F.sum("child").cast("long").alias("n_children"), F.max("ends").alias("ends")
        )
        # the words of the path from the top node to the fork, each spared by all conversations but one
        spared = F.aggregate("path_words", F.lit(0).cast("long"), lambda a, w: a + w)
        joined = made.join(sums, "head").withColumn("saved_tokens", F.col("below_saved") + (F.col("n_convs") - 1) * spared)
        now = materialize(joined, "trie-totals")
        done = now if done is None else done.unionByName(now)
        below = below.unionByName(now.select("above", "conv_id", "n_convs", "n_leaves", "saved_tokens", F.lit(1).alias("child"), F.lit(None).cast("string").alias("ends")))
    return done


def trie(seqs: DataFrame, limit: int | None = None) -> DataFrame:
    """The nodes of the trie over ``sequences``.

    conv_id (the least of the conversations that start with the node's turns), depth, parent_conv_id (the
    parent's conv_id, null for the root), n_convs, n_children, n_leaves (childless nodes of its subtree, itself
    included), saved_tokens (over its subtree, words of the last turn for each conversation but one) and ends_sha256 (of the conv_ids
    that end at the node).
    """
    seqs = materialize(seqs, "trie-sequences")
    distinct = materialize(_distinct(seqs), "trie-distinct")
    if limit is None:
        limit = min(MOST_LIMIT, max(LEAST_LIMIT, distinct.count() // SHARE))
    containers, heads, stopped = _burst(distinct, limit)
    dealt = containers.select("head", "depth", "above", "ids", "words", "n", "conv_id", "ends").repartition("head").sortWithinPartitions("head", "ids")
    swept = dealt.mapInArrow(_sweep, f"{NODE}, above binary, top boolean")
    if not heads:
        return swept.drop("above", "top")
    swept = materialize(swept, "trie-nodes")
    totals = _add_up(swept.filter("top"), heads, stopped)
    n_heads = sum(n for _, n in heads)
    over = totals.select(F.col("head").alias("above"), F.col("conv_id").alias("__above"))
    tops = swept.filter("top").join(_small(over, n_heads), "above")
    tops = tops.withColumn("parent_conv_id", F.col("__above"))
    # the nodes of a head's path have the same members; saved words grow from the fork up
    at = F.col("__depth") - F.greatest(F.col("depth"), F.lit(1))  # the root has no turn and no words
    spared = F.aggregate(F.slice("path_words", F.greatest(at, F.lit(0)) + 1, F.size("path_words")), F.lit(0).cast("long"), lambda a, w: a + w)
    path = totals.join(_small(over.withColumnRenamed("above", "__up"), n_heads), F.col("above") == F.col("__up"), "left")
    path = path.select("*", F.posexplode(F.sequence("depth", "fork")).alias("__step", "__depth"))
    last = F.col("__depth") == F.col("fork")
    nodes = path.select(
        "conv_id",
        F.col("__depth").alias("depth"),
        F.when(F.col("__depth") > F.col("depth"), F.col("conv_id")).otherwise(F.col("__above")).alias("parent_conv_id"),
        "n_convs",
        F.when(last, F.col("n_children")).otherwise(1).alias("n_children"),
        "n_leaves",
        (F.col("below_saved") + (F.col("n_convs") - 1) * spared).alias("saved_tokens"),
        F.when(last, F.coalesce("ends", F.lit(EMPTY_SHA))).otherwise(EMPTY_SHA).alias("ends_sha256"),
    )
    columns = nodes.columns
    return swept.filter("not top").select(*columns).unionByName(tops.select(*columns)).unionByName(nodes)


def last_turns(nodes: DataFrame, seqs: DataFrame) -> DataFrame:
    """``nodes`` with turn_id, the id of each node's last turn (null for the root), taken from the conversation that it is named by."""
    own = seqs.select(F.col("conv_id").alias("__conv"), F.posexplode("turns").alias("__at", "__turn"))
    return nodes.join(own, (F.col("conv_id") == F.col("__conv")) & (F.col("depth") == F.col("__at") + 1), "left").select(*nodes.columns, F.col("__turn.id").alias("turn_id"))
