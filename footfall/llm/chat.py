"""Reply trees to training conversations.

Messages form trees by their parent's id. Paths from root to leaf are found by
pointer doubling: each round joins the table of jumps with itself, so a tree of
depth d takes about log2(d) joins on (tree, node). Each leaf gets the total score
of its path, the leaves of a tree are ranked by mean score, and each chosen path
becomes one conversation.

The template writes a turn as ``<s>role<t>text</s>``. Inside roles and texts an
ampersand is put after each ``<`` that starts ``<s>``, ``<t>``, ``</s>`` or ``<&``,
so a marker never occurs inside a text; taking the ampersand after each ``<`` out
gives the text back.

Nulls: a null text or role is the empty string, a null score is 0, a parent that
does not exist makes its child a root. Equal scores go by the leaf's node id. Messages that
only lead to one another in a circle have no root and are left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from footfall.llm.common import materialize, shared_dir

OPEN, SAYS, CLOSE = "<s>", "<t>", "</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(?=&|t>|/?s>)", "<&")


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<&"), F.lit("<"))


def from_turns(turns: DataFrame) -> DataFrame:
    """Rows by turn as a reply tree: each turn answers the one before it in its conversation.

    Turns with equal numbers are ordered by role and text, a null number comes first.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    return turns.select(F.col("conv_id").alias("tree_id"), node.alias("node_id"), (node - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def best_paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """Rows (tree_id, leaf_id, path_rank, position, node_id): the ``keep`` best paths of each tree.

    ``messages`` has tree_id, node_id, parent_id and score; (tree_id, node_id) is unique.
    """
    nodes = messages.select(F.struct("tree_id").alias("tree"), "node_id", "parent_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    ids = nodes.select("tree", F.col("node_id").alias("parent_id"), F.lit(True).alias("__known"))
    linked = nodes.join(ids, ["tree", "parent_id"], "left")
    base = f"{shared_dir(messages.sparkSession)}/chat-jumps-{uuid.uuid4().hex}"
    start = linked.select("tree", "node_id", F.when(F.col("__known"), F.col("parent_id")).alias("up"), F.lit(1).cast("long").alias("steps"), "score")
    start.write.parquet(f"{base}/round=0")

    def table() -> DataFrame:
        return messages.sparkSession.read.schema(StructType([*start.schema.fields, StructField("round", IntegerType())])).parquet(base)

    rounds, n_messages = 0, table().count()  # no path is longer than the table
    while not table().filter((F.col("round") == rounds) & F.col("up").isNotNull()).isEmpty() and 2**rounds <= n_messages:
        live = table().filter((F.col("round") == rounds) & F.col("up").isNotNull()).drop("round")
        # where a jump lands: at one that goes on, or at one that has come to its root in any round
        far = table().filter((F.col("up").isNull()) | (F.col("round") == rounds)).select("tree", F.col("node_id").alias("up"), F.col("up").alias("__up"), F.col("steps").alias("__steps"), F.col("score").alias("__score"))
        doubled = live.join(far, ["tree", "up"]).select("tree", "node_id", F.col("__up").alias("up"), (F.col("steps") + F.col("__steps")).alias("steps"), (F.col("score") + F.col("__score")).alias("score"))
        rounds += 1
        doubled.write.parquet(f"{base}/round={rounds}")
    jumps = table().filter(F.col("round") == 0)
    ended = table().filter(F.col("up").isNull())
    parents = jumps.filter(F.col("up").isNotNull()).select("tree", F.col("up").alias("node_id")).distinct()
    leaves = ended.join(parents, ["tree", "node_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc(F.col("score") / F.col("steps")), "node_id"))
    chosen = leaves.withColumn("path_rank", rank).filter(F.col("path_rank") <= keep).select("tree", F.col("node_id").alias("leaf_id"), "path_rank", F.col("steps").alias("position"), "node_id")
    on_path = chosen
    for level in reversed(range(rounds)):  # each jump taken or not: all distances from the leaf
        hop = table().filter((F.col("round") == level) & F.col("up").isNotNull()).select("tree", "node_id", "up")
        on_path = on_path.unionByName(on_path.join(hop, ["tree", "node_id"]).select("tree", "leaf_id", "path_rank", (F.col("position") - 2**level).alias("position"), F.col("up").alias("node_id")))
        on_path = materialize(on_path, "chat-paths") if level else on_path
    return on_path.select(F.col("tree.tree_id").alias("tree_id"), "leaf_id", "path_rank", (F.col("position") - 1).alias("position"), "node_id")


def format_trees(messages: DataFrame, keep: int = 1, learn_from: str = "assistant") -> DataFrame:
    """One row for each chosen path: tree_id, leaf_id, path_rank, formatted, spans.

    ``spans`` are the places (start and length in code points, from 0) of the texts
    by ``learn_from``, in order: the loss mask.
    """
    paths = best_paths(messages, keep).withColumn("tree", F.struct("tree_id")).drop("tree_id")
    body = messages.select(F.struct("tree_id").alias("tree"), "node_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(SAYS))
    turns = paths.join(body, ["tree", "node_id"]).select("tree", "leaf_id", "path_rank", "position", (F.col("role") == learn_from).alias("learn"), head.alias("head"), escape(F.col("text")).alias("said"))
    before = Window.partitionBy("tree", "leaf_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length("head") + F.char_length("said") + len(CLOSE)
    placed = turns.withColumn("at", (F.coalesce(F.sum(size).over(before), F.lit(0)) + F.char_length("head")).cast("long"))
    span = F.when(F.col("learn"), F.struct("position", F.col("at").alias("start"), F.char_length("said").cast("long").alias("length")))
    whole = placed.groupBy("tree", "leaf_id", "path_rank").agg(
        F.array_sort(F.collect_list(F.struct("position", F.concat("head", "said", F.lit(CLOSE)).alias("turn")))).alias("turns"),
        F.array_sort(F.collect_list(span)).alias("spans"),
    )
    return whole.select(F.col("tree.tree_id").alias("tree_id"), "leaf_id", "path_rank", F.array_join("turns.turn", "").alias("formatted"), F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Add ``turns``, an array of (role, text), and ``loss_text`` to what ``format_trees`` returned."""
    pieces = F.split(F.col("formatted"), CLOSE)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, SAYS, 1)
        return F.struct(unescape(F.substring(role, len(OPEN) + 1, 1 << 30)).alias("role"), unescape(F.substr(piece, F.char_length(role) + (len(SAYS) + 1))).alias("text"))

    learnt = F.transform("spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("*", F.transform(pieces, turn).alias("turns"), F.array_join(learnt, "").alias("loss_text"))
