"""Source divergence audit: how far the words of each source are from those of every other source of its language.

A group is a (lang, source). Over the terms that a language keeps, those in at least ``min_docs`` of its documents, each
group and each language has smoothed shares p = 1 + floor(10^9 (count + 1) / (N + V)), and the divergence at a term is
f(p, q) = floor((p - q)^2 / q), p the group's and q its peer's or the language's. All of it is whole-number arithmetic, exact for counts up to 2.8e14.

The sum over all terms for each pair of groups is a sparse matrix product done by Gustavson's rows: a task holds a part of
the term-major index (for each term, the groups that have it, with their shares). Each group scatters its terms through it
into a dense accumulator, a number for each peer, so no pair of postings is ever a row; only the accumulators leave the task. A term that
a group lacks has the baseline share of a count of 0. The accumulators hold what differs from two baselines: f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0) for
terms of both, and f(p, q0) - f(p0, q0) and f(p0, q) - f(p0, q0) for all terms of either, counted by distinct shares. V f(p0, q0) is added at the end.

Texts are counted in their tasks, and counts leave a task once for each group and term, so a group that holds a third of
all rows is no hot key. Null text, lang and source are empty strings; a group without terms, and a language that keeps none, have their rows too.
Repeated rows count as often as they are there. An empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.llm.common import materialize, texts_for_python

#: The whole that shares are parts of: 10^9, as two factors so that 64 bits hold the products.
SHARES = 31_250, 32_000
#: Terms that a task counts before it gives them out.
TERMS_HELD = 400_000
#: Postings that a task scatters at once, and numbers in its accumulators.
POSTINGS_HELD, NUMBERS_HELD = 1_000_000, 4_000_000
#: Groups that are broadcast to the index; more are shuffled.
FEW_GROUPS = 100_000
#: Bytes of words, with A-Z in lower case; all other ASCII characters part them.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of each group, of the rows of a task."""
    counts: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}
    held = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        for group, terms in counts.items():
            n, seen = len(terms), docs[group]
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([group[0]] * n, pa.string()),
                    "source": pa.array([group[1]] * n, pa.string()),
                    "term": pa.array(list(terms), pa.binary()).cast(pa.string()),
                    "n": pa.array(terms.values(), pa.int64()),
                    "docs": pa.array([seen[t] for t in terms], pa.int64()),
                }
            )
        counts.clear()
        docs.clear()

    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
            words = text.translate(_WORDS).split()
            total = counts.setdefault((lang, source), Counter())
            before = len(total)
            total.update(words)
            docs.setdefault((lang, source), Counter()).update(set(words))
            held += len(total) - before
            if held > TERMS_HELD:
                yield from flushed()
                held = 0
    yield from flushed()


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (n + v)) in whole numbers, by a division in two steps."""
    above, below = count + 1, n + v
    first = above * SHARES[0]
    return F.call_function("div", first, below) * SHARES[1] + F.call_function("div", F.call_function("mod", first, below) * SHARES[1], below) + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def _share(count: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    above, below = count + 1, n + v
    first, rest = np.divmod(above * SHARES[0], below)
    return first * SHARES[1] + rest * SHARES[1] // below + 1


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _scatterer(langs: dict[str, tuple[int, np.ndarray]]):
    """A function over rows of the index (lang, numbers and counts of the groups of a term) that sums what each pair of groups differs by from two baselines.

    ``langs`` has for each language how many terms it keeps and the total of each of its groups.
    """

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}  # of a group, as p: a number for each peer
        turned: dict[tuple[str, int], np.ndarray] = {}  # of a group, as q
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flushed() -> Iterator[pa.RecordBatch]:
            for table, named in ((sums, ("p_group", "q_group")), (turned, ("q_group", "p_group"))):
                for (lang, group), values in table.items():
                    some = np.flatnonzero(values)
                    own = pa.array(np.full(len(some), group, np.int32))
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(some), pa.string()), named[0]: own, named[1]: pa.array(some.astype(np.int32)), "value": pa.array(values[some])}).select(["lang", "p_group", "q_group", "value"])
                table.clear()

        def block(lang: str) -> int:
            """Scatter the terms that wait; how many numbers the accumulators hold."""
            kept, totals = langs[lang]
            base = _share(np.zeros(len(totals), np.int64), totals, kept)
            peers, counts, sizes = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            shares = _share(counts, totals[peers], kept)
            starts = np.cumsum(sizes) - sizes
            term = np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(peers, kind="stable")  # the group-major rows of the same postings
            cuts = np.append(np.flatnonzero(np.diff(peers[order], prepend=-1)), len(order))
            for a, b in zip(cuts, cuts[1:], strict=False):
                mine = order[a:b]
                group, own = int(peers[mine[0]]), shares[mine]
                if (lang, group) not in sums:
                    sums[lang, group], turned[lang, group] = np.zeros(len(base), np.int64), np.zeros(len(base), np.int64)
                row, column, zero = sums[lang, group], turned[lang, group], base[group]
                distinct, times = np.unique(own, return_counts=True)
                for d, t in zip(np.array_split(distinct, parts := 1 + len(distinct) * len(base) // NUMBERS_HELD), np.array_split(times, parts), strict=True):
                    row += ((_apart(d[:, None], base) - _apart(zero, base)) * t[:, None]).sum(0)
                    column += ((_apart(base, d[:, None]) - _apart(base, zero)) * t[:, None]).sum(0)
                for i, j in _pieces(sizes[term[mine]]):  # its terms through the index, each to all its groups
                    s = sizes[term[mine[i:j]]]
                    at = np.repeat(starts[term[mine[i:j]]] - np.cumsum(s) + s, s) + np.arange(s.sum())
                    peer, p, q = peers[at], np.repeat(own[i:j], s), shares[at]
                    np.add.at(row, peer, _apart(p, q) - _apart(p, base[peer]) - _apart(zero, q) + _apart(zero, base[peer]))
            return sum(map(len, sums.values()))

        now, held = None, 0
        for batch in batches:
            names = batch.column("lang").to_pylist()
            starts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(names)], strict=True):
                if waiting and (names[a] != now or held > POSTINGS_HELD):
                    if block(now) > NUMBERS_HELD:
                        yield from flushed()
                    held = 0
                now, part = names[a], batch.slice(a, b - a)
                ends = part.column("numbers").offsets.to_numpy()
                numbers, counts = (part.column(c).values.to_numpy()[ends[0] : ends[-1]] for c in ("numbers", "counts"))
                waiting.append((numbers, counts, np.diff(ends)))
                held += len(numbers)
        if waiting:
            block(now)
        yield from flushed()

    return scatter


def _pieces(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of ``sizes`` that sum to ``POSTINGS_HELD`` or are single."""
    total, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + POSTINGS_HELD, "right")))
        yield i, j
        i = j


def _few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= FEW_GROUPS else df


def divergence(documents: DataFrame, min_docs: int = 3, top: int = 200, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: the audit of every group.

    Part ``pair`` has each other source of the language with the divergence summed over all kept terms; part ``term``
    the ``top`` kept terms that the group has and that have a larger share in it than in its language, with their divergence. Ranks go by value, largest first, then item.
    """
    lang, source, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col, text_col))
    named = documents.select(lang.alias("lang"), source.alias("source")).distinct()
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    named = materialize(named.withColumn("number", number), "divergence-groups")
    n_groups = named.count()
    counted = texts_for_python(documents, lang.alias("lang"), source.alias("source"), text.alias("text")).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    # one shuffle by term serves the counts of groups and of languages
    postings = counted.join(_few(named, n_groups), ["lang", "source"]).repartition("lang", "term").groupBy("lang", "term", "number").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    index = postings.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.collect_list("number").alias("numbers"), F.collect_list("n").alias("counts"))
    index = materialize(index.filter(F.col("docs") >= min_docs).drop("docs").sortWithinPartitions("lang"), "divergence-index")
    flat = index.select("lang", "term", "lang_n", F.inline(F.arrays_zip("numbers", "counts")).alias("number", "n"))
    per_group = flat.groupBy("lang", "number").agg(F.sum("n").alias("total"))
    per_lang = index.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("kept"))
    groups = named.join(per_group, ["lang", "number"], "left").join(per_lang, "lang", "left")
    groups = groups.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total", "lang_total", "kept")})
    some = F.when(F.col("kept") > 0, F.col("kept"))
    groups = materialize(groups.withColumn("base", share(F.lit(0).cast("long"), F.col("total"), some)), "divergence-totals")
    totals = groups.filter("kept > 0").groupBy("lang", "kept").agg(F.array_sort(F.collect_list(F.struct("number", "total"))).alias("own"))
    # a number for each group; the result has one for each pair of them
    langs = {r["lang"]: (r["kept"], np.array([x["total"] for x in r["own"]], np.int64)) for r in totals.collect()}
    sums = index.select("lang", "numbers", "counts").mapInArrow(_scatterer(langs), "lang string, p_group int, q_group int, value long").groupBy("lang", "p_group", "q_group").agg(F.sum("value").alias("differs"))
    one, other = groups.alias("one"), groups.alias("other")
    pairs = one.join(other, (F.col("one.lang") == F.col("other.lang")) & (F.col("one.number") != F.col("other.number")))
    zero = apart(F.col("one.base"), F.col("other.base")) * F.col("one.kept")
    pairs = pairs.select("one.lang", "one.source", F.col("other.source").alias("item"), F.col("one.number").alias("p_group"), F.col("other.number").alias("q_group"), zero.alias("zero"))
    total = F.coalesce("zero", F.lit(0)) + F.coalesce("differs", F.lit(0))
    line = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.join(sums, ["lang", "p_group", "q_group"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", total.alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(line))
    known = flat.join(_few(groups.drop("base"), n_groups), ["lang", "number"])
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    terms = known.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter(F.col("p") > F.col("q"))
    terms = terms.select("lang", "source", "part", "item", apart(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= top)
    return pairs.unionByName(terms)
