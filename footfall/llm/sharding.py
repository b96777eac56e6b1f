"""Hierarchical weighted hash tree: documents to shards by descent through region, rack and shard.

At each node a document draws an exponential variate for each child, from a hash of its key and the child's place in the tree,
divided by the weight below the child, and goes down to the least. So every child is taken in proportion to its weight, and only
the children of the node it stands at are ever drawn: regions, then the racks of one, then the shards of one.

Growth keeps the tree that documents were placed by. What is added since, a new shard or more weight for an old one, draws beside the regions
with its own weight, and a document that draws it least goes straight to its shard; all others descend as before. An addition takes
rows only into its own shard, whatever the number of shards, and in proportion to its weight. A weight that shrinks in the tree itself makes rows leave
the subtrees that hold it, and no others move.

Nulls: a null key hashes as the empty string, a null text has no bytes. Equal keys go to one
shard. Extra columns of the input are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import dense_rank_in_groups

#: Bytes that a row takes besides its text.
ROW_OVERHEAD = 16


def tree(n_shards: int, racks: int = 2, shards_per_rack: int = 5) -> list[list[list[int]]]:
    """Regions of racks of shard numbers; shards fill a rack, then a region, then open the next."""
    shards = list(range(n_shards))
    in_racks = [shards[i : i + shards_per_rack] for i in range(0, n_shards, shards_per_rack)]
    return [in_racks[i : i + racks] for i in range(0, len(in_racks), racks)]


#: Hexadecimal digits of a draw, and draws that one digest gives.
DIGITS, IN_DIGEST = 6, 5


def _least(key: Column, name: Column, weights: Column) -> Column:
    """draw and at: the least of the draws for children of these weights (an array), below the node of that name."""
    digests = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(weights) - 1) / IN_DIGEST).cast("int")), lambda k: F.substring(F.md5(F.concat(key, name, k.cast("string"))), 1, DIGITS * IN_DIGEST)), "")

    def draw(weight: Column, at: Column) -> Column:
        u = (F.conv(F.substr(digests, at * DIGITS + 1, F.lit(DIGITS)), 16, 10).cast("double") + 1.0) / float(16**DIGITS + 1)
        return F.struct((-F.log(u) / weight).alias("draw"), at.alias("at"))

    return F.array_min(F.transform(weights, draw))


def _doubles(values: list) -> Column:
    """A nested list of numbers as arrays."""
    return F.array(*[_doubles(v) if isinstance(v, list) else F.lit(float(v)) for v in values])


def with_shard(rows: DataFrame, key: Column, to: str, weights: list[float], racks: int = 2, shards_per_rack: int = 5, added: list[tuple[int, float]] | None = None) -> DataFrame:
    """Add the shard of ``key`` as column ``to``, by descent.

    ``weights`` are those of the shards that the tree was laid out for, above 0. ``added`` is what came since, in turn: shards, new or old, with
    the weight that each got more; its order is part of the law, so it is only ever appended to.
    """
    added = added or []
    if not weights or min([*weights, *(w for _, w in added)]) <= 0:
        raise ValueError("there must be shards, of weights above 0")
    regions = tree(len(weights), racks, shards_per_rack)
    of_shard = [[[weights[s] for s in rack] for rack in region] for region in regions]
    of_rack = [[sum(rack) for rack in region] for region in of_shard]
    # the rows travel as one column beside what is drawn for them, so no name can clash
    out = rows.select(F.struct(*rows.columns).alias("row"), F.coalesce(key.cast("string"), F.lit("")).alias("key"))
    out = out.withColumn("region", _least(F.col("key"), F.lit("/"), _doubles([sum(r) for r in of_rack])))
    g = F.col("region.at")
    out = out.withColumn("rack", _least(F.col("key"), F.concat(F.lit("/"), g.cast("string"), F.lit("/")), F.get(_doubles(of_rack), g))["at"])
    r = F.col("rack")
    name = F.concat(F.lit("/"), g.cast("string"), F.lit("/"), r.cast("string"), F.lit("/"))
    out = out.withColumn("place", _least(F.col("key"), name, F.get(F.get(_doubles(of_shard), g), r))["at"])
    shard = (g * racks + r) * shards_per_rack + F.col("place")
    if added:
        out = out.withColumn("more", _least(F.col("key"), F.lit("/more/"), _doubles([w for _, w in added])))
        shard = F.when(F.col("more.draw") < F.col("region.draw"), F.get(F.array(*[F.lit(s) for s, _ in added]), F.col("more.at"))).otherwise(shard)
    return out.select(*(F.col("row")[c].alias(c) for c in rows.columns if c != to), shard.cast("int").alias(to))


def shard_documents(documents: DataFrame, n_shards: int = 40, racks: int = 2, shards_per_rack: int = 5, id_col: str = "doc_id", text_col: str = "text", laid_out: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, and grown_shard: the shard if there were one more.

    The tree is laid out for ``laid_out`` shards (all, by default), the others were added since. ``slot`` numbers the rows of a shard
    from 0 without holes. Only digests of the texts are shuffled.
    """
    laid_out = n_shards if laid_out is None else laid_out
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    for to, n in (("shard", n_shards), ("grown_shard", n_shards + 1)):
        rows = with_shard(rows, F.col("doc_id"), to, [1.0] * laid_out, racks, shards_per_rack, [(s, 1.0) for s in range(laid_out, n)])
    return dense_rank_in_groups(rows, ["shard"], ["doc_id", "text_crc32", "size"], "slot").select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard")
