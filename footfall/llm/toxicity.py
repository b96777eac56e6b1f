"""Toxicity by weak supervision.

Voters are patterns that a text either shows or does not: a lexicon of whole words and of word
starts, shown once or at least twice, found among the labelled documents as those that stand out in toxic or in clean
ones, and patterns of shape (repeated marks, shouting, no words at all). A generative label
model says how likely each voter fires on toxic and on clean documents, and which voters
only repeat one another: expectation-maximisation estimates the rates, the correlation of two
voters within a class divides what they add. Its posteriors are the labels on which a linear
classifier (logistic, L2) over all the voters and the shape of the text is trained. That
classifier scores every whole text.

Voters are found among all labelled documents, and the label model is fitted on all documents, labelled or not, as sums
that Spark takes of them in each round; those whose crc32 of the id mod 5 is 0 are held out of both. A label starts
the posterior of its document and later is one more voter. Only the classifier is fitted on at most
``max_labelled`` labelled documents, one row for each id, chosen by a digest of the id; this bound and the number of voters are
what makes driver memory and broadcasts constant. It starts from the label model's weights, which voters keep that those rows don't show.
Labels of one document that differ are averaged. A null text is the empty one. With no labels at all every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import materialize, texts_for_python
from footfall.llm.tokens import chunks, strings

#: Labelled documents of the classifier at most, lexicon entries at most for each side, documents that a lexicon entry needs at least.
MAX_LABELLED, MAX_VOTERS, MIN_DOCUMENTS = 20_000, 600, 4
STARTS = range(3, 8)
#: Before a pattern: it must occur at least twice in the text.
TWICE = "2"
#: Stands for the documents themselves among the patterns counted.
EVERY = ""
#: How often a gold label is taken to be right.
TRUST = 0.95
STRIP = "\"'`.,;:!?()[]{}<>|*#_-…»«“”„’"


def bare_words(words: pa.Array) -> pa.Array:
    """Words in lower case, without the marks round them, as Python has it; most words are ASCII, where Arrow agrees."""
    out = pc.utf8_trim(pc.ascii_lower(words), STRIP)
    other = pc.invert(pc.string_is_ascii(words))
    return pc.replace_with_mask(out, other, pa.array([w.lower().strip(STRIP) for w in strings(words.filter(other))], pa.string()))


def kinds(bare: pa.Array) -> Iterator[tuple[str, pa.Array]]:
    """What bare words can be known by: themselves, and their starts. A mark for each kind, and the words' parts (null: none)."""
    length = pc.utf8_length(bare)
    yield "=", pc.if_else(pc.greater(length, 0), bare, None)
    for n in STARTS:
        yield "^", pc.if_else(pc.greater_equal(length, n), pc.utf8_slice_codeunits(bare, 0, n), None)


def _pairs(row: np.ndarray, code: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (row, code), and whether each comes more than once or was ``many`` already."""
    width = int(code.max(initial=0)) + 1
    key = np.sort(((row * width + code) << 1) | many)
    pair = key >> 1
    starts = np.flatnonzero(np.diff(pair, prepend=-1))
    ends = np.append(starts[1:], len(pair))[: len(starts)] - 1
    return pair[starts] // width, pair[starts] % width, (ends > starts) | (key[ends] & 1 > 0)


def _coded(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For each word of some texts the number of its text and of its bare word; the bare words."""
    flat = pc.list_flatten(words).dictionary_encode()
    bare = bare_words(flat.dictionary).dictionary_encode()
    row = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
    return row, bare.indices.to_numpy()[flat.indices.to_numpy()], bare.dictionary


def pattern_counts(texts: pa.Array, toxic: np.ndarray) -> Iterator[pa.RecordBatch]:
    """pattern, n, t: how many of the texts show it, and the sum of ``toxic`` over these."""

    def counts(names: pa.Array, n: np.ndarray, t: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([names, pa.array(n, pa.int64()), pa.array(t, pa.float64())], ["pattern", "n", "t"])

    yield counts(pa.array([EVERY], pa.string()), np.array([len(texts)]), np.array([toxic.sum()]))
    row, code, bare = _coded(pc.utf8_split_whitespace(texts))
    row, code, many = _pairs(row, code, np.zeros(len(row), bool))
    for mark, parts in kinds(bare):
        named = parts.dictionary_encode()
        own = pc.fill_null(named.indices, -1).to_numpy()[code]
        some = own >= 0
        in_row, of, twice = _pairs(row[some], own[some], many[some])
        for before, shown in ((mark, np.ones(len(of), bool)), (TWICE + mark, twice)):
            n = np.bincount(of[shown], minlength=len(named.dictionary))
            t = np.bincount(of[shown], toxic[in_row[shown]], len(named.dictionary))
            yield counts(pc.binary_join_element_wise(before, named.dictionary.filter(pa.array(n > 0)), ""), n[n > 0], t[n > 0])


def shape(texts: pa.Array) -> np.ndarray:
    """Patterns of shape: no words, a shouted word, repeated exclamation or question marks, masked letters."""
    return np.stack([pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False) for p in SHAPES], 1).astype(np.int8)


#: Patterns of shape, as regular expressions.
SHAPES = (r"\A\s*\z", r"\b[A-Z]{4,}\b", r"[!?]{2,}", r"[A-Za-z][*@$#]{2,}")


@dataclass
class Model:
    voters: list[str]
    weights: np.ndarray  # of voters, then shapes
    bias: float


def _fired(texts: pa.Array, index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, voter), each once: which voters of the lexicon fire on which texts."""
    base = {p: i for i, p in enumerate(sorted({v.removeprefix(TWICE) for v in index}))}
    once, twice = (np.array([index.get(mark + p, -1) for p in base] or [-1], np.int64) for mark in ("", TWICE))
    in_row, code, bare = _coded(pc.ascii_split_whitespace(texts))
    rows, voters = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for mark, parts in kinds(bare):
        own = {p[1:]: i for p, i in base.items() if p[0] == mark}
        at = pc.fill_null(pc.index_in(parts, value_set=pa.array(list(own), pa.string())), -1).to_numpy()
        hit = np.flatnonzero((at >= 0)[code])
        rows.append(in_row[hit]), voters.append(np.array([*own.values(), -1], np.int64)[at[code[hit]]])
    row, voter, many = _pairs(np.concatenate(rows), np.concatenate(voters), np.zeros(sum(map(len, rows)), bool))
    row = np.concatenate([row, row[many]])
    voter = np.concatenate([once[voter], twice[voter[many]]])
    real = voter >= 0
    order = np.argsort(row[real], kind="stable")
    return row[real][order], voter[real][order]


def _eligible(df: DataFrame) -> DataFrame:
    """Rows to learn from: those whose crc32 of the id mod 5 isn't 0."""
    return df.filter(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 0)


def gold_labels(labels: DataFrame) -> DataFrame:
    """doc_id, toxic (0 to 1) of every labelled document to learn from."""
    known = _eligible(labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()))
    return known.groupBy("doc_id").agg(F.avg(F.col("toxic").cast("double")).alias("toxic"))


def _lexicon(rows: DataFrame, per_side: int) -> list[str] | None:
    """Patterns that stand out in toxic or in clean documents, by the lower bound of their log-odds; None without rows."""

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(0)):
                yield from pattern_counts(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a).to_numpy())

    counted = rows.select("text", "toxic").mapInArrow(patterns, "pattern string, n long, t double").groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    counted = materialize(counted.filter((F.col("n") >= MIN_DOCUMENTS) | (F.col("pattern") == EVERY)), "toxicity-patterns")
    total = counted.filter(F.col("pattern") == EVERY).first()
    if total is None:
        return None
    n, t = total["n"], total["t"]
    a, b = F.col("t") + 0.5, F.col("n") - F.col("t") + 0.5
    odds = F.log(a / b) - F.log(F.lit((t + 0.5) / (n - t + 0.5)))
    sure = odds.alias("odds"), F.sqrt(1.0 / a + 1.0 / b).alias("error")
    counted = counted.filter(F.col("pattern") != EVERY).select("pattern", *sure)
    out = []
    for sign in (1.0, -1.0):
        bound = F.lit(sign) * F.col("odds") - 1.65 * F.col("error")
        out += [r["pattern"] for r in counted.withColumn("bound", bound).filter(F.col("bound") > 0.2).orderBy(F.desc("bound"), "pattern").limit(per_side).collect()]
    return sorted(set(out))


@dataclass
class Sums:
    """What the label model needs to know of its documents under posteriors p: numbers that add up."""

    n: float
    p: float
    pp: float
    qq: float  # q is 1 - p
    pq: float
    yes: np.ndarray
    no: np.ndarray
    moved: float  # the largest change of a posterior

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.n + other.n, self.p + other.p, self.pp + other.pp, self.qq + other.qq, self.pq + other.pq, self.yes + other.yes, self.no + other.no, max(self.moved, other.moved))


def _sums(votes: np.ndarray, p: np.ndarray, moved: float) -> Sums:
    q = 1 - p
    return Sums(len(p), p.sum(), p @ p, q @ q, p @ q, p @ votes, q @ votes, moved)


def _weights(s: Sums, together: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-odds without any vote, and what each vote adds."""
    prior = np.clip(s.p / s.n, 1e-3, 1 - 1e-3)
    on, off = (s.yes + 0.1) / (s.p + 0.2), (s.no + 0.1) / (s.n - s.p + 0.2)
    # covariance of what the classes leave unexplained: sums over (votes - p on - (1 - p) off), multiplied out
    cross = np.outer(on, s.yes) + np.outer(off, s.no)
    mixed = np.outer(on, off) * s.pq
    rest = together - cross - cross.T + np.outer(on, on) * s.pp + np.outer(off, off) * s.qq + mixed + mixed.T
    scale = np.sqrt(np.maximum(np.diag(rest), 0)) + 1e-6 * np.sqrt(s.n)
    shared = rest / np.outer(scale, scale)
    np.fill_diagonal(shared, 0)
    share = 1.0 / (1.0 + (shared**2).sum(0))
    fires, silent = np.log(on / off) * share, np.log((1 - on) / (1 - off)) * share
    return float(np.log(prior / (1 - prior)) + silent.sum()), (fires - silent).astype(np.float32)


def _posterior(votes: np.ndarray, gold: np.ndarray, by: tuple[float, np.ndarray] | None, trust: float) -> np.ndarray:
    """Posteriors of the toxic class; without weights the gold labels' own. No gold label (NaN) is no vote."""
    if by is None:
        return np.clip(gold.astype(float), 1 - trust, trust)
    vote_of_gold = np.log(trust / (1 - trust)) * (2 * np.nan_to_num(gold, nan=0.5) - 1)
    return 1 / (1 + np.exp(-np.clip(by[0] + votes @ by[1] + vote_of_gold, -30, 30)))


def label_model(votes: np.ndarray, gold: np.ndarray, rounds: int = 20, trust: float = TRUST) -> np.ndarray:
    """Posterior of the toxic class from votes (documents x voters, 0 or 1).

    EM over a two-class model: rates of each voter in each class, started from ``gold``, which later counts as one
    more voter that is right with probability ``trust``. Voters that correlate within the classes share their evidence: each
    one's log-likelihood ratio is divided by one plus the sum of its squared correlations with the others.
    """
    votes = votes.astype(np.float32)
    together, p = (votes.T @ votes).astype(float), _posterior(votes, gold, None, trust)
    for _ in range(rounds):
        new = _posterior(votes, gold, _weights(_sums(votes, p, 0.0), together), trust)
        moved, p = np.abs(new - p).max(), new
        if moved < 1e-4:
            break
    return p


def _unpacked(rows: Iterable, n_voters: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Votes (documents x voters) and gold labels of packed rows."""
    for r in rows:
        gold, sizes, fired = np.frombuffer(r["gold"]), np.frombuffer(r["sizes"], np.int32), np.frombuffer(r["fired"], np.int32)
        votes = np.zeros((len(gold), n_voters), np.float32)
        votes[np.repeat(np.arange(len(gold)), sizes), fired] = 1
        yield votes, gold


def label_weights(voted: DataFrame, n_voters: int, rounds: int = 20, trust: float = TRUST) -> tuple[float, np.ndarray]:
    """``label_model`` over a table (fired: indices of voters, toxic: gold label or null) of any size, as the weights of the posterior.

    The first round is over the labelled documents, the others over all. Each is one pass that adds up sums in the executors.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gold = batch.column(1).cast(pa.float64()).fill_null(float("nan")).to_numpy()
            parts = gold, np.diff(batch.column(0).offsets.to_numpy()).astype(np.int32), batch.column(0).flatten().to_numpy().astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["gold", "sizes", "fired"])

    packed = materialize(voted.select("fired", "toxic").mapInArrow(pack, "gold binary, sizes binary, fired binary"), "toxicity-votes").rdd

    def pairs(rows: Iterable) -> Iterator[tuple]:
        every, known = np.zeros((n_voters, n_voters)), np.zeros((n_voters, n_voters))
        for votes, gold in _unpacked(rows, n_voters):
            own = votes[~np.isnan(gold)]
            every += votes.T @ votes
            known += own.T @ own
        yield every, known

    def one_round(before: tuple | None, last: tuple | None, first: bool) -> Sums:
        def work(rows: Iterable) -> Iterator[Sums]:
            total = Sums(0.0, 0.0, 0.0, 0.0, 0.0, np.zeros(n_voters), np.zeros(n_voters), 0.0)
            for votes, gold in _unpacked(rows, n_voters):
                if first:
                    votes, gold = votes[~np.isnan(gold)], gold[~np.isnan(gold)]
                if len(gold):
                    p = _posterior(votes, gold, last, trust)
                    moved = np.nanmax(np.abs(p - _posterior(votes, gold, before, trust)), initial=0.0)
                    total = total + _sums(votes, p, float(moved))
            yield total

        return packed.mapPartitions(work).treeReduce(lambda a, b: a + b)

    every, known = packed.mapPartitions(pairs).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))
    before, last = None, _weights(one_round(None, None, True), known)
    for _ in range(rounds - 1):
        sums = one_round(before, last, False)
        if sums.moved < 1e-4:
            break
        before, last = last, _weights(sums, every)
    return last


def linear_classifier(features: np.ndarray, target: np.ndarray, l2: float = 1e-4, rounds: int = 500, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by accelerated gradient steps.

    ``start`` (weights, then bias; 0 by default) is where it begins and what L2 draws the weights to, so a feature that no row shows keeps it.
    """
    x = np.hstack([features, np.ones((len(features), 1))]).astype(np.float32)
    top = np.ones(x.shape[1], np.float32)
    for _ in range(30):  # the largest eigenvalue, by power iteration; a little more than that is safe
        top = x.T @ (x @ top)
        size = float(np.linalg.norm(top))
        top = top / size
    step = np.float32(4.0 / (1.1 * size / len(x) + l2))
    origin = np.zeros(x.shape[1], np.float32) if start is None else start.astype(np.float32)
    w = v = origin
    target = target.astype(np.float32)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        grad = x.T @ (p - target) / np.float32(len(x)) + np.float32(l2) * np.append((v - origin)[:-1], np.float32(0))
        new = v - step * grad
        v, w = new + np.float32(k / (k + 3)) * (new - w), new
    return w[:-1].astype(float), float(w[-1])


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_voters: int = MAX_VOTERS) -> Model:
    """Find voters, weigh them by the label model and train the classifier on its posteriors."""
    gold, docs = gold_labels(labels), documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    taught = _eligible(docs).join(gold.hint("merge"), "doc_id")  # the same plan at every size: how many labels there are isn't bounded
    voters = _lexicon(texts_for_python(taught, "text", "toxic"), max_voters // 2)
    if voters is None:
        return Model([], np.zeros(len(SHAPES)), -30.0)
    index, n_voters = {v: i for i, v in enumerate(voters)}, len(voters) + len(SHAPES)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                texts = batch.column(1).slice(a, b - a)
                row, voter = _fired(texts, index)
                own_row, own = np.nonzero(shape(texts))
                row, voter = np.concatenate([row, own_row]), np.concatenate([voter, own + len(voters)]).astype(np.int32)
                at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b - a))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(at), pa.array(voter[np.argsort(row, kind="stable")]))], ["doc_id", "fired"])

    name = docs.schema["doc_id"].dataType.simpleString()
    fired = _eligible(texts_for_python(docs, "doc_id", "text")).mapInArrow(vote, f"doc_id {name}, fired array<int>")
    voted = materialize(fired.join(gold, "doc_id", "left"), "toxicity-voted")
    weights = label_weights(voted, n_voters)

    known = voted.filter(F.col("toxic").isNotNull())
    chosen = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    got = known.join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("fired").alias("fired"), F.min("toxic").alias("toxic")).orderBy("doc_id").collect()  # at most max_labelled rows
    votes = np.zeros((len(got), n_voters), np.float32)
    for i, r in enumerate(got):
        votes[i, r["fired"]] = 1
    target = _posterior(votes, np.array([r["toxic"] for r in got]), weights, TRUST)
    return Model(voters, *linear_classifier(votes, target, start=np.append(weights[1], weights[0])))


def score(model: Model):
    """A scalar Arrow function: whole texts to scores between 0 and 1."""
    index = {v: i for i, v in enumerate(model.voters)}
    n, weights, bias = len(index), model.weights, model.bias

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts, out = pc.fill_null(batch, ""), [np.zeros(0)]
            for a, b in chunks(texts):
                part = texts.slice(a, b - a)
                row, voter = _fired(part, index)
                sums = np.bincount(row, weights[voter], minlength=b - a) + shape(part) @ weights[n:] + bias
                out.append(1 / (1 + np.exp(-np.clip(sums, -30, 30))))
            yield pa.array(np.concatenate(out))

    return scores


def toxicity(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_voters: int = MAX_VOTERS) -> DataFrame:
    """``documents`` with toxicity_score; every row stays, and every column."""
    return texts_for_python(documents, "*").withColumn("toxicity_score", score(fit(documents, labels, max_labelled, max_voters))(F.col("text")))

