"""Document fingerprints as Merkle trees over sections, paragraphs and cuts.

A paragraph is a line. It is cut after any white space that follows n or a mark of
punctuation: the cuts are the tree's leaves. A section ends after each paragraph whose digest starts
with 0 to 3 and at the text's end. Content decides all of these, so an edit moves no distant boundary.
A leaf is half the MD5 of its text behind that of the cut before it in the paragraph, so its place matters; a paragraph's node
is the SHA-256 of its leaves, a section's that of its paragraphs' nodes, the root's that of the sections' nodes. Equal roots mean equal texts.

Two trees are compared from the root down, and only what differs is opened: nodes that both have are
set aside, each as often as both have it, first sections, then the paragraphs of the others, then the leaves of the
paragraphs left. The leaf of an empty cut counts nothing. The likeness of two texts is the Dice coefficient of leaves and root: equal texts have 1, others less.
``locate_edits`` descends in the same way to the run of paragraphs outside which both texts agree.

A null text is the empty one. Extra columns are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A paragraph whose node is below this ends its section.
SECTION_END = "4"
CUT = r"([n.,;:!?|)][ \t\r\f\x0B]+)"
MARK = "\u0001"
#: Between leaves, between a paragraph's node and its leaves, after a paragraph, after a section.
LEAF, HAS, PARAGRAPH, SECTION = " ", "=", "/", "|"
#: Hexadecimal digits of a paragraph's node and of a leaf; the leaf of an empty cut.
NODE, DIGITS = 64, 16
EMPTY_LEAF = hashlib.md5(b"").hexdigest()[:DIGITS]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where ``use`` reads it in a loop."""
    return F.transform(F.array(value), use)[0]


def tree(text: Column) -> Column:
    """The tree of a text as the array of its sections: each is its paragraphs, nodes and leaves written in order."""
    marked = F.regexp_replace(text, CUT, f"$1{MARK}")

    def leaves(cuts: Column) -> Column:
        own = lambda x, i: F.when(x == "", EMPTY_LEAF).otherwise(F.substring(F.md5(F.concat(F.when(i > 0, F.get(cuts, i - 1)).otherwise(""), F.lit(MARK), x)), 1, DIGITS))
        return F.array_join(F.transform(cuts, own), LEAF)

    lines = F.transform(F.transform(F.split(marked, "\n"), lambda p: F.split(p, MARK)), leaves)
    nodes = F.transform(lines, lambda p: F.struct(F.sha2(p, 256).alias("node"), p.alias("leaves")))
    whole = F.array_join(F.transform(nodes, lambda p: F.concat(p["node"], F.lit(HAS), p["leaves"], F.when(p["node"] < SECTION_END, SECTION).otherwise(PARAGRAPH))), "")
    return F.split(F.regexp_replace(whole, r"[/|]\z", ""), r"\|")


def _paragraphs(section: Column) -> Column:
    return F.split(section, PARAGRAPH)


def section_nodes(sections: Column) -> Column:
    """Digests of the sections, in order."""
    return F.transform(sections, lambda s: F.sha2(F.array_join(F.transform(_paragraphs(s), lambda p: F.substring(p, 1, NODE)), LEAF), 256))


def root(sections: Column) -> Column:
    return F.sha2(F.array_join(section_nodes(sections), ""), 256)


def _numbered(nodes: Column) -> Column:
    """A multiset as a set: equal strings get numbers, so that each is one of a kind. Order is lost where there are equal ones."""

    def runs(s: Column) -> Column:
        first = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i)), lambda i: i.isNotNull())

        def number(starts: Column) -> Column:
            size = lambda at, k: F.coalesce(F.get(starts, k + 1), F.size(s)) - at
            return F.flatten(F.transform(starts, lambda at, k: F.transform(F.slice(s, at + 1, size(at, k)), lambda x, n: F.concat(x, F.lit("#"), n.cast("string")))))

        return _let(first, number)

    return F.when(F.size(F.array_distinct(nodes)) == F.size(nodes), F.transform(nodes, lambda x: F.concat(x, F.lit("#0")))).otherwise(_let(F.sort_array(nodes), runs))


def _plain(nodes: Column) -> Column:
    return F.transform(nodes, lambda x: F.substring_index(x, "#", 1))


def _leaves(paragraphs: Column) -> Column:
    """The leaves of paragraphs, in order, without those of empty cuts."""
    written = F.array_join(F.transform(paragraphs, lambda p: F.substring(p, NODE + 2, 1 << 30)), LEAF)
    return F.when(F.size(paragraphs) == 0, F.array().cast("array<string>")).otherwise(F.array_remove(F.split(written, LEAF), EMPTY_LEAF))


def n_leaves(sections: Column) -> Column:
    """How many leaves, but for those of empty cuts, a tree has: known from how long it is written, as all its parts have fixed lengths."""

    def occurrences(text: Column, of: str) -> Column:
        return (F.length(text) - F.length(F.replace(text, F.lit(of), F.lit("")))) / len(of)

    def count(whole: Column) -> Column:
        leaves = (F.length(whole) - (NODE + 1) * occurrences(whole, HAS) + 1) / (DIGITS + 1)
        return (leaves - occurrences(whole, EMPTY_LEAF)).cast("int")

    return _let(F.array_join(sections, PARAGRAPH), count)


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two trees' leaves and roots, between 0 and 1, found by opening only what differs."""

    def of_a_kind(v: Column) -> Column:
        """Both multisets as sets."""
        distinct = F.struct(F.array_distinct(v["x"]).alias("x"), F.array_distinct(v["y"]).alias("y"))
        return _let(distinct, lambda d: F.when((F.size(d["x"]) == F.size(v["x"])) & (F.size(d["y"]) == F.size(v["y"])), F.struct(d.alias("of"), F.lit(False).alias("numbered"))).otherwise(F.struct(F.struct(_numbered(v["x"]).alias("x"), _numbered(v["y"]).alias("y")).alias("of"), F.lit(True).alias("numbered"))))

    def sets(x: Column, y: Column, use: Callable[[Column, Column, Column], Column]) -> Column:
        return _let(_let(F.struct(x.alias("x"), y.alias("y")), of_a_kind), lambda v: use(v["of"]["x"], v["of"]["y"], v["numbered"]))

    def differing(x: Column, y: Column, use: Callable[[Column, Column], Column]) -> Column:
        """``use`` of what only one of two multisets has."""
        plain = lambda left, numbered: F.when(numbered, _plain(left)).otherwise(left)
        return sets(x, y, lambda p, q, numbered: _let(F.struct(plain(F.array_except(p, q), numbered).alias("x"), plain(F.array_except(q, p), numbered).alias("y")), lambda d: use(d["x"], d["y"])))

    def opened(x: Column, y: Column) -> Column:
        below = F.flatten(F.transform(x, _paragraphs)), F.flatten(F.transform(y, _paragraphs))
        return differing(*below, lambda p, q: sets(_leaves(p), _leaves(q), lambda k, m, _: F.size(k) + F.size(m) - 2 * F.size(F.array_intersect(k, m))))

    own, other = n_leaves(a), n_leaves(b)
    apart = differing(a, b, opened)  # leaves that only one of the two has
    return F.when(a == b, 1.0).otherwise((own + other - apart) / (own + other + 2))


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tree, sections and fingerprint (the root) of each document."""
    trees = documents.select(F.col(id_col).alias("doc_id"), tree(F.coalesce(F.col(text_col), F.lit(""))).alias("tree"))
    return trees.select("doc_id", "tree", section_nodes(F.col("tree")).alias("sections"), root(F.col("tree")).alias("fingerprint"))


def _agreeing(a: Column, b: Column) -> Column:
    """How many of the first elements of two arrays agree."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(at == 0, F.size(a)).otherwise(at - 1).cast("int")


def _middle(a: Column, b: Column) -> Column:
    """first, and the parts of both arrays without what agrees at their starts and at their ends."""

    def ends(first: Column) -> Column:
        x, y = F.slice(a, first + 1, F.size(a)), F.slice(b, first + 1, F.size(b))
        return _let(_agreeing(F.reverse(x), F.reverse(y)), lambda last: F.struct(first.alias("first"), F.slice(x, F.lit(1), F.size(x) - last).alias("a"), F.slice(y, F.lit(1), F.size(y) - last).alias("b")))

    return _let(_agreeing(a, b), ends)


def locate_edits(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, first, removed, added: from paragraph ``first`` on (from 0), ``removed`` paragraphs gave way to ``added``.

    Outside that run both texts agree; it is a shortest such run. A paragraph that moved is in it. Both tables are
    what ``fingerprints`` returns; documents with equal roots are left out without looking further, and
    of the others only the sections between those that agree are opened.
    """
    old = before.select("doc_id", F.col("fingerprint").alias("__root"), F.col("tree").alias("__old"))
    changed = after.join(old, "doc_id").filter(F.col("fingerprint") != F.col("__root"))
    sections = changed.select("doc_id", "__old", _middle(F.col("__old"), F.col("tree")).alias("open"))
    opened = sections.select(
        "doc_id",
        F.size(F.flatten(F.transform(F.slice("__old", F.lit(1), F.col("open.first")), _paragraphs))).alias("earlier"),
        _middle(F.flatten(F.transform("open.a", _paragraphs)), F.flatten(F.transform("open.b", _paragraphs))).alias("run"),
    )
    return opened.select("doc_id", (F.col("earlier") + F.col("run.first")).alias("first"), F.size("run.a").alias("removed"), F.size("run.b").alias("added"))


def id_ranges(ids: Column, cuts: list[int], parts: int) -> Column:
    """Number of the range of an id, ascending: between two neighbouring cuts, ``parts`` ranges of equal width. Null: -1."""
    wide = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    heads = F.array(*[F.lit(g[0]) for g in groups])
    tails = F.array(*[F.array(*[F.lit(c) for c in g]) for g in groups])
    group = F.greatest(F.size(F.filter(heads, lambda c: c <= ids)), F.lit(1))
    place = (group - 1) * wide + F.size(F.filter(F.get(tails, group - 1), lambda c: c <= ids)) - 1
    if parts > 1:
        lows, highs = F.array(*[F.lit(c) for c in cuts]), F.array(*[F.lit(c) for c in [*cuts[1:], cuts[-1] + 1]])
        low, high = F.get(lows, F.greatest(place, F.lit(0))), F.get(highs, F.greatest(place, F.lit(0)))
        place = place * parts + F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor((ids - low) / (high - low) * parts).cast("int")))
    return F.coalesce(place, F.lit(-1))


#: Ranges whose order is found together: what one task gets is the number of all ranges over this, or this.
RANGES_TOGETHER = 4096


def with_next(documents: DataFrame, id_col: str, text_col: str, rows_per_range: int = 1024, max_cuts: int = 1024) -> DataFrame:
    """doc_id, text and next_text: the text of the following document by id, the first's for the last.

    Documents are dealt into ranges of ids at quantiles (at most ``max_cuts`` numbers come to
    the driver; beyond, ranges are cut evenly between two quantiles), and every range is ordered by
    itself. The first text of each range is what follows the last of the range before it.
    Equal ids follow one another in the order of their texts.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = docs.select("doc_id").count()
    n_cuts = max(1, min(max_cuts, rows // rows_per_range))
    cuts = sorted({int(c) for c in docs.approxQuantile("doc_id", [i / n_cuts for i in range(n_cuts)], 0.25 / n_cuts)}) or [0]
    ranged = docs.withColumn("range", id_ranges(F.col("doc_id"), cuts, max(1, rows // (rows_per_range * max_cuts))))
    line = Window.partitionBy("range").orderBy("doc_id", "text")
    inside = ranged.withColumn("__next", F.lead("text").over(line))
    ranges = ranged.groupBy("range").agg(F.lit(1)).select("range", F.floor(F.col("range") / RANGES_TOGETHER).alias("__many"))  # a row for each range
    many = ranges.groupBy("__many").agg(F.max("range").alias("__last"))  # a row for each ``RANGES_TOGETHER`` ranges
    in_order = Window.orderBy("__many")
    many = many.select("__many", F.coalesce(F.lag("__last").over(in_order), F.max("__last").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("__far"))
    order = ranges.withColumn("__near", F.lag("range").over(Window.partitionBy("__many").orderBy("range"))).join(many, "__many").select("range", F.coalesce("__near", "__far").alias("before"))
    heads = ranged.withColumn("__at", F.row_number().over(line)).filter(F.col("__at") == 1)  # Spark keeps one row for each range and task before it shuffles these
    firsts = heads.join(order, "range").select("before", F.col("text").alias("__first"))
    return inside.join(firsts, F.col("range") == F.col("before")).select("doc_id", "text", F.coalesce("__next", "__first").alias("next_text"))
