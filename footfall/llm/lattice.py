"""Language-model scores by a subword lattice: the marginal probability of a text over all its segmentations.

The pieces are those of an existing vocabulary, whose own scores are the start from
which their unigram probabilities are re-estimated on the training words
(expectation-maximisation over the lattice, forward and backward in log space; each distinct word
counts once, as the lattice is there for words that are rare). A word begins with the mark ``▁``; no piece
goes across words, so a text's lattice falls apart into those of its words. A character that no piece
has is spelt by its bytes' pieces. One further edge runs along the whole of a word that training
texts have: with the lattice's share ``a`` (as many as there are words seen once, plus one), count ``c`` of ``N``
training tokens and lattice probability ``q``, the word's is ``p = (c + a q) / (N + a)``. The end of a text is a
token of its own, with the piece for it.

Texts fall into classes, say languages, that have weights of their own: in a class the pieces' probabilities ``q`` are
re-estimated once more on its own words, and the counts ``c'`` and ``N'`` of its training texts give ``(c' + a' p) / (N' + a')``. The class of a text to be scored is not looked at: its probability is
the sum over the classes, each weighted by its share of the training texts.

Statistics are over all words of all texts. The words that are most frequent, a fixed number, are scored
where they stand; every other word by a join. A null text is the empty one: its end only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import materialize, texts_for_python
from footfall.llm.tokens import chunks, strings

MARK, END = "▁", " "  # a blank is in no word
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)  # odd numbers: a rolling hash, and one that spreads it over all bits
#: Frequent words that are scored in place; characters of the words that are worked on at once.
HOT_WORDS, AT_ONCE = 100_000, 1 << 18
#: Words that a task takes together.
WORDS_AT_ONCE = 1 << 16
#: Classes at most that stand by themselves: the largest; training texts of all others, and of none, are one class more.
MAX_CLASSES = 8
FILTER_BITS = 21


def vocabulary(model_file: str) -> tuple[list[str], np.ndarray]:
    """Pieces of a sentencepiece file and their first log-probabilities, from its scores (ranks, negated)."""
    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(own.get_piece_size()) if not own.is_control(i) and not own.is_unknown(i)]
    pieces = [own.id_to_piece(i) for i in ids]
    rank = np.array([-own.get_score(i) for i in ids])
    weight = 1.0 / (rank - rank.min() + 10.0)
    return [*pieces, END], np.log(np.append(weight, weight.mean()) / (weight.sum() + weight.mean()))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _add_logs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """log(exp(x) + exp(y)) of finite numbers; ``np.logaddexp`` in steps that numpy has vector code for."""
    top = np.maximum(x, y)
    return top + np.log(1.0 + np.exp(np.minimum(x, y) - top))


class Lattice:
    """Forward and backward sums over the segmentations of many words at once.

    Pieces are found by rolling hashes. A place is followed on only as long as what starts there begins some piece.
    """

    def __init__(self, pieces: list[str], logp: np.ndarray):
        self.pieces, self.logp = pieces, logp
        self.bytes_at = {int(p[3:5], 16): i for i, p in enumerate(pieces) if len(p) == 6 and p.startswith("<0x")}
        no_text = {*self.bytes_at.values(), *(i for i, p in enumerate(pieces) if p == END)}
        ids = np.array([i for i in range(len(pieces)) if i not in no_text])
        sizes = np.array([len(pieces[i]) for i in ids])
        self.longest = int(sizes.max())
        flat = np.frombuffer("".join(pieces[i] for i in ids).encode("utf-32-le"), np.uint32)
        codes = np.zeros((len(ids), self.longest), np.uint64)
        codes[np.arange(self.longest) < sizes[:, None]] = flat.astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest, BASE)]))
            now, prefixes = np.zeros(len(ids), np.uint64), []
            hashes = np.zeros(len(ids), np.uint64)
            for k in range(1, self.longest + 1):
                now = now * BASE + codes[:, k - 1]
                prefixes.append((now[sizes >= k] + np.uint64(k)) * MIX)
                hashes[sizes == k] = (now[sizes == k] + np.uint64(k)) * MIX
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], ids[order]
        self.maybe, self.begins = np.zeros(1 << FILTER_BITS, bool), np.zeros(1 << FILTER_BITS, bool)
        head = self.hashes >> np.uint64(64 - FILTER_BITS)
        self.maybe[head] = True
        places, first, n = np.unique(head, return_index=True, return_counts=True)
        self.first, self.run_length = np.zeros(1 << FILTER_BITS, np.int32), int(n.max())
        self.first[places] = first
        self.begins[np.concatenate(prefixes) >> np.uint64(64 - FILTER_BITS)] = True

    def _edges(self, codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length of a piece, from 1: rows, first places and pieces, wherever one is found, by place and row."""
        n, size = codes.shape
        prefix = np.zeros((size + 1, n), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(size):
                prefix[j + 1] = prefix[j] * BASE + (codes[:, j].astype(np.uint64) + np.uint64(1))
            prefix = prefix.ravel()
            at, out = np.arange(n * size), []
            first = prefix[at]
            for k in range(1, min(self.longest, size) + 1):
                room = np.searchsorted(at, n * (size - k + 1))
                at, first = at[:room], first[:room]
                keys = (prefix[at + k * n] - first * self.powers[k] + np.uint64(k)) * MIX
                place = keys >> np.uint64(64 - FILTER_BITS)
                some = np.flatnonzero(self.maybe[place])
                wanted, found = keys[some], self.first[place[some]].astype(np.int64)
                real = self.hashes[found] == wanted
                for _ in range(self.run_length - 1):  # pieces whose hashes start alike lie side by side
                    other = np.flatnonzero(~real)
                    found[other] = np.minimum(found[other] + 1, len(self.hashes) - 1)
                    real[other] = self.hashes[found[other]] == wanted[other]
                where = at[some[real]]
                out.append((where % n, where // n, self.ids[found[real]]))
                go_on = self.begins[place]
                at, first = at[go_on], first[go_on]
        return out

    def _spelt(self, codes: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, dict[int, list[int]]]:
        """Log-probabilities of each character by its bytes, under each model, and the pieces that spell it."""
        distinct, where = np.unique(codes, return_inverse=True)
        spelt = {int(c): [self.bytes_at[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in distinct}
        return np.array([logp[spelt[int(c)]].sum(0) for c in distinct]).reshape(len(distinct), -1)[where.ravel()], spelt

    def run(self, words: list[str], counts: np.ndarray | None = None, others: list[np.ndarray] = ()) -> tuple[np.ndarray, np.ndarray | None]:
        """Log-probability of each word; with ``counts``, also how often each piece is expected in them.

        ``counts`` is words x kinds, and so are the expected numbers pieces x kinds. With ``others``, more
        log-probabilities of the pieces, there is a row of results for each, after the lattice's own.
        """
        models = np.stack([self.logp, *others], 1)
        out = np.zeros((models.shape[1], len(words)))
        expected = np.zeros((len(self.pieces), counts.shape[1])) if counts is not None else None
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        by_size = np.argsort(sizes, kind="stable")
        edges = np.flatnonzero(np.diff(sizes[by_size], prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(words)], strict=True):
            size = int(sizes[by_size[a]])
            step = max(1, AT_ONCE // size)
            for i in range(a, b, step):
                rows = by_size[i : min(b, i + step)]
                text = "".join(MARK + words[r] for r in rows)
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(rows), size)
                out[:, rows] = self._group(codes, models, counts[rows] if counts is not None else None, expected)
        return (out if len(others) else out[0]), expected

    def _group(self, codes: np.ndarray, models: np.ndarray, counts: np.ndarray | None, expected: np.ndarray | None) -> np.ndarray:
        """Log-probabilities (models x words) of words of one size; ``expected`` grows by what ``counts`` words show."""
        n, size = codes.shape
        edges = self._edges(codes)
        row, place, piece = edges[0]
        single = np.full((size, n), -1)
        single[place, row] = piece
        weight = models[single]  # by place, word and model
        unknown = np.nonzero(single < 0)
        spelling: dict[int, list[int]] = {}
        if len(unknown[0]):
            weight[unknown], spelling = self._spelt(codes[unknown[1], unknown[0]], models)
        longer = [(k, row, place, piece, models[piece], np.searchsorted(place, np.arange(size + 1))) for k, (row, place, piece) in enumerate(edges[1:], 2) if len(row)]
        forward = np.zeros((size + 1, n, models.shape[1]))
        for j in range(1, size + 1):
            now = forward[j - 1] + weight[j - 1]
            for k, row, _, _, w, starts in longer:
                if j >= k:
                    a, b = starts[j - k], starts[j - k + 1]
                    own = row[a:b]
                    now[own] = _add_logs(now[own], forward[j - k][own] + w[a:b])
            forward[j] = now
        if counts is None:
            return forward[size].T
        front = forward[:, :, 0]
        backward = np.zeros((size + 1, n))
        for j in range(size - 1, -1, -1):
            now = backward[j + 1] + weight[j, :, 0]
            for k, row, _, _, w, starts in longer:
                if j + k <= size:
                    a, b = starts[j], starts[j + 1]
                    own = row[a:b]
                    now[own] = _add_logs(now[own], backward[j + k][own] + w[a:b, 0])
            backward[j] = now
        whole = front[size]
        for k, row, place, piece, w, _ in [(1, *edges[0], models[edges[0][2]], None), *longer]:
            share = np.exp(front[place, row] + w[:, 0] + backward[place + k, row] - whole[row])
            for kind in range(counts.shape[1]):
                expected[:, kind] += np.bincount(piece, share * counts[row, kind], minlength=len(expected))
        if spelling:
            place, row = unknown
            share = np.exp(front[place, row] + weight[place, row, 0] + backward[place + 1, row] - whole[row])
            for i, c, s in zip(row.tolist(), codes[row, place].tolist(), share.tolist(), strict=True):
                for b in spelling[c]:
                    expected[b] += s * counts[i]
        return whole[None]


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = WORDS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``rows``: batches of texts are small, words can be taken together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Text of each word, the distinct words, and which of them each word is; A-Z in lower case."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = pc.list_flatten(words).dictionary_encode()
    at = words.offsets.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    codes, distinct = flat.indices.to_numpy(), strings(flat.dictionary)
    if "" in distinct:
        real = codes != distinct.index("")
        row, codes = row[real], codes[real]
    return row, distinct, codes


def word_counts(documents: DataFrame, n_classes: int) -> DataFrame:
    """word, n (in all texts), c (in training texts), c0, c1, ... (in those of each class) from text, train and class.

    ``class`` is a number from 0, or null. The end of texts is the word ``END``.
    """
    names = ["word", "n", "c", *(f"c{k}" for k in range(n_classes))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, train = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            own = np.where(train, batch.column(2).fill_null(-1).to_numpy(), -1)
            for a, b in chunks(texts):
                row, distinct, codes = _words(texts.slice(a, b - a))
                picks = [np.ones(b - a, bool), train[a:b], *(own[a:b] == k for k in range(n_classes))]
                n = [np.bincount(codes[pick[row]], minlength=len(distinct)) for pick in picks]
                some = np.flatnonzero(n[0])
                words = pa.array([*(distinct[i] for i in some.tolist()), END], pa.string())
                yield pa.RecordBatch.from_arrays([words, *(pa.array(np.append(x[some], int(pick.sum()))) for x, pick in zip(n, picks, strict=True))], names)

    schema = ", ".join(["word string", *(f"{c} long" for c in names[1:])])
    return documents.select("text", "train", "class").mapInArrow(count, schema).groupBy("word").agg(*(F.sum(c).alias(c) for c in names[1:]))


def _normal(counted: np.ndarray) -> np.ndarray:
    """Log-probabilities of the pieces from their expected numbers, and of the end."""
    got = counted + 0.01
    got[-1] = max(got.sum() * 1e-3, 1.0)
    return np.log(got / got.sum())


def estimate(counts: DataFrame, pieces: list[str], logp: np.ndarray, rounds: int, by_class: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Log-probabilities of the pieces after some rounds over the distinct training words, and those of each class.

    The last round also counts by class; a class's numbers are smoothed by those of all.
    """
    classes = [logp] * len(by_class)
    for round_ in range(rounds):
        now, columns = logp, ["c", *(by_class if round_ == rounds - 1 else [])]

        def expect(batches: Iterator[pa.RecordBatch], now: np.ndarray = now, columns: list[str] = columns) -> Iterator[pa.RecordBatch]:
            lattice, total = Lattice(pieces, now), np.zeros((len(pieces), len(columns)))
            for batch in _gathered(batches):
                total += lattice.run(strings(batch.column("word")), np.stack([batch.column(c).to_numpy() > 0 for c in columns], 1).astype(float))[1]
            some = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, i]) for i in range(len(columns)))], ["piece", *columns])

        summed = counts.filter((F.col("c") > 0) & (F.col("word") != END)).select("word", *columns).mapInArrow(expect, "piece long, " + ", ".join(f"{c} double" for c in columns))
        rows = summed.groupBy("piece").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()  # a row for each piece of the vocabulary at most
        numbers = np.zeros((len(pieces), len(columns)))
        numbers[rows["piece"].to_numpy()] = np.stack([rows[c].to_numpy() for c in columns], 1)
        logp = _normal(numbers[:, 0])
        classes = [_normal(numbers[:, k] + 100.0 * np.exp(logp)) for k in range(1, len(columns))] or classes
    return logp, classes


def lattice_scores(documents: DataFrame, train: str = "train", class_col: str | None = None, model_file: str | None = None, rounds: int = 2, hot_words: int = HOT_WORDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of each row of doc_id, text and ``train``."""
    learn = F.coalesce(train, F.lit(False))
    own = F.lit(0)
    n_classes = 1
    if class_col:
        sizes = documents.filter(learn).groupBy(F.col(class_col).alias("class")).count()
        largest = sizes.filter(F.col("class").isNotNull()).orderBy(F.desc("count"), "class").limit(MAX_CLASSES).collect()
        others = (sizes.agg(F.sum("count")).first()[0] or 0) > sum(r["count"] for r in largest)
        n_classes = max(1, len(largest) + others)
        own = F.coalesce(*[F.when(F.col(class_col) == r["class"], k) for k, r in enumerate(largest)], F.lit(n_classes - 1))
    docs = texts_for_python(documents, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), learn.alias("train"), own.cast("int").alias("class"))
    pieces, logp = vocabulary(model_file or default_vocabulary())
    by_class = [f"c{k}" for k in range(n_classes)]
    counts = materialize(word_counts(docs, len(by_class)), "word-counts")
    columns = ["c", *by_class]
    total = counts.agg(F.count_if(F.col("c") > 0).alias("v"), *(F.coalesce(F.sum(c), F.lit(0)).alias(f"sum_{c}") for c in columns), *(F.count_if(F.col(c) == 1).alias(f"once_{c}") for c in columns), *(F.coalesce(F.sum(F.when(F.col("word") == END, F.col(c))), F.lit(0)).alias(f"texts_{c}") for c in columns)).first()
    n, v = total["sum_c"], total["v"]
    sums, shares = [total[f"sum_{c}"] for c in columns], [float(total[f"once_{c}"] + 1) for c in columns]
    texts = sum(total[f"texts_{c}"] for c in by_class)
    prior = [(total[f"texts_{c}"] / texts if texts else 1.0 / len(by_class)) for c in by_class]
    logp, own_logp = estimate(counts, pieces, logp, rounds, by_class)
    scores = [f"s{k}" for k in range(len(by_class))]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces, logp)
        for batch in _gathered(batches):
            words, seen = strings(batch.column("word")), [batch.column(c).to_numpy() for c in columns]
            q = lattice.run([w if w != END else "" for w in words], others=own_logp)[0]
            for row, weights in zip(q, [logp, *own_logp], strict=True):
                row[[i for i, w in enumerate(words) if w == END]] = weights[-1]
            with np.errstate(divide="ignore"):
                each = []
                for own, c, m, a in zip(q[1:], seen[1:], sums[1:], shares[1:], strict=True):
                    p = np.logaddexp(np.log(seen[0]), np.log(shares[0]) + own) - np.log(sums[0] + shares[0])
                    each.append((np.logaddexp(np.log(c), np.log(a) + p) - np.log(m + a)) / np.log(10))
            base = np.log10((seen[0] + 0.5) / (n + 0.5 * (v + 1)))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array((seen[0] > 0).astype(float)), pa.array(base), *map(pa.array, each)], ["word", "n", "known", "base", *scores])

    values = ["known", "base", *scores]
    scored = materialize(counts.mapInArrow(judge, "word string, n long, " + ", ".join(f"{c} double" for c in values)), "word-scores")
    level = F.floor(F.log2(F.col("n").cast("double")) * 16)
    least, held = 1 << 30, 0
    for r in scored.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # sixteen for each power of two
        held += r["count"]
        if held > hot_words:
            break
        least = r["level"]
    hot = scored.filter(level >= least).select("word", *values).toArrow()  # at most ``hot_words`` rows
    known_values = np.stack([hot[c].to_numpy() for c in values], 1)
    table = documents.sparkSession.sparkContext.broadcast((hot["word"].combine_chunks(), known_values))
    del hot
    names = ["row_id", "word", "doc_id", "times", "n_tokens", *values]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_known, known = table.value
        index = {w: i for i, w in enumerate(strings(names_known))}
        known = np.vstack([known, np.zeros((1, len(values)))])
        nowhere = len(known) - 1
        end = known[index.get(END, nowhere)]
        row_id = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                row, distinct, codes = _words(batch.column(1).slice(a, b - a))
                place = np.fromiter((index.get(w, nowhere) for w in distinct), np.int64, len(distinct))
                where, size = place[codes], b - a
                tokens = np.bincount(row, minlength=size) + 1
                here = [pa.array(np.bincount(row, known[where, k], minlength=size) + end[k]) for k in range(len(values))]
                ids = np.arange(row_id, row_id + size)
                key = pa.array([f" {i}" for i in ids.tolist()], pa.string())  # no word has a blank: these rows meet none
                yield pa.RecordBatch.from_arrays([pa.array(ids), key, batch.column(0).slice(a, size), pa.array(np.zeros(size, np.int64)), pa.array(tokens), *here], names)
                rare = where == nowhere
                pairs, times = np.unique(row[rare] * max(1, len(distinct)) + codes[rare], return_counts=True)
                m = len(pairs)
                if m:
                    words = pa.array(distinct, pa.string()).take(pa.array(pairs % len(distinct)))
                    nil = pa.array(np.zeros(m))
                    yield pa.RecordBatch.from_arrays([pa.array(row_id + pairs // len(distinct)), words, pa.nulls(m, pa.int64()), pa.array(times), pa.array(np.zeros(m, np.int64)), *[nil] * len(values)], names)
                row_id += size

    parts = docs.select("doc_id", "text").mapInArrow(add, "row_id long, word string, doc_id long, times long, n_tokens long, " + ", ".join(f"{c} double" for c in values))
    words = scored.select("word", *(F.col(c).alias(f"__{c}") for c in values))
    plus = [F.sum(F.col(c) + F.coalesce(F.col("times") * F.col(f"__{c}"), F.lit(0.0))).alias(c) for c in values]
    summed = parts.join(words, "word", "left").groupBy("row_id").agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), *plus)
    weighed = F.array(*[F.col(s) + F.log10(F.lit(max(p, 1e-300))) for s, p in zip(scores, prior, strict=True)])
    top = F.array_max(weighed)
    score = top + F.log10(F.aggregate(weighed, F.lit(0.0), lambda acc, x: acc + F.pow(F.lit(10.0), x - top)))
    return summed.select("doc_id", "n_tokens", F.rint("known").cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), score.alias("score"))
