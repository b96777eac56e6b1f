"""Language identification: a sparse multinomial logistic regression on TF-IDF character n-grams, calibrated by a temperature.

Letters are lower-cased; all else parts words and becomes one space. Every n-gram of one to three characters of the whole text is
hashed to a bucket; a document's features are 1 + ln of its buckets' counts, times their inverse document frequency, scaled to length one.
Document frequencies come from all rows to learn from. The weights are fitted by follow-the-regularised-leader with
per-coordinate rates and an elastic net: a weight whose evidence stays under the L1 penalty is exactly zero, the L2 penalty
shrinks the others. They see at most ``ROWS`` rows, dealt evenly over the languages and chosen by a hash of id and text, of which a fifth is kept back to
fit the temperature that the scores are divided by. Training is one pass order fixed by hashes, so results don't depend on partitioning.

Edges: a text that is null or has no letter is ``und`` with score 0. A table without rows to learn from makes every text ``und``. With
one language to learn, every text with a letter is of it, with score 1. Repeated rows are predicted alike and, within one task, picked once. A language
is whatever ``lang_col`` holds in the rows to learn from, null apart.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.llm.common import materialize, texts_for_python

UNDETERMINED = "und"
#: Buckets that n-grams are hashed to, and the n-grams' longest.
BITS, LONGEST = 16, 3
#: Odd multipliers of the hashes of n-grams, one for each place.
MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)
#: Rows that the weights and the temperature are fitted on, at most.
ROWS = 6_000
#: One in so many of them is for the temperature.
KEPT_BACK = 5
#: Follow-the-regularised-leader: rate, smoothing of the rate, L1 and L2 penalties, passes.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 2e-3, 1e-4, 2
#: Characters that are hashed at once.
AT_ONCE = 1_000_000


@cache
def _plain() -> tuple[np.ndarray, np.ndarray]:
    """For each code point what it counts as (letters lower-cased, marks, else a space), and whether it is a letter."""
    to, letter = np.full(0x110000, 32, np.uint32), np.zeros(0x110000, bool)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))
        if kind[0] in "LM":
            lower = chr(code).lower()
            to[code] = ord(lower) if len(lower) == 1 else code
            letter[code] = kind[0] == "L"
    return to, letter


def _hashes(plain: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram at each place."""
    width = max(0, len(plain) - n + 1)
    h = np.full(width, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h ^= plain[k : width + k]
        h *= MIX[k]
        h ^= h >> np.uint32(15)
    return (h >> np.uint32(32 - BITS)).astype(np.uint16)


def _single_spaces(plain: np.ndarray) -> np.ndarray:
    keep = np.ones(len(plain), bool)
    keep[1:] = (plain[1:] != 32) | (plain[:-1] != 32)
    return keep


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _long(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """``buckets`` of a text by pieces, each with the end of the one before as context."""
    to, letter = _plain()
    counts, spelled, tail = np.zeros(1 << BITS, np.int64), False, np.full(1, 32, np.uint32)
    for i in range(0, len(text), AT_ONCE):
        codes = _codes(text[i : i + AT_ONCE])
        spelled = spelled or bool(letter[codes].any())
        plain = np.concatenate([tail, to[codes]])
        plain = plain[_single_spaces(plain)]
        for n in range(1, LONGEST + 1):
            first = max(0, len(tail) - n + 1) if i else 0  # n-grams of the context alone are counted
            counts += np.bincount(_hashes(plain[first:], n), minlength=len(counts))
        tail = plain[1 - LONGEST :]
    at = np.flatnonzero(counts)
    return (at.astype(np.int32), counts[at].astype(np.int32)) if spelled else None


def buckets(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """For each text the buckets of its n-grams, ascending, and their counts; None if it has no letter.

    Short texts are hashed together, up to ``AT_ONCE`` characters at a time.
    """
    out: list = [None] * len(texts)
    part, size = [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        if len(text) > AT_ONCE:
            out[i] = _long(text)
            continue
        if size + len(text) > AT_ONCE:
            _together(texts, part, out)
            part, size = [], 0
        part.append(i)
        size += len(text)
    if part:
        _together(texts, part, out)
    return out


def _together(texts: list[str | None], part: list[int], out: list) -> None:
    to, letter = _plain()
    codes = _codes("".join(f" {texts[i]}" for i in part))
    ends = np.cumsum([len(texts[i]) + 1 for i in part])
    starts = np.append(0, ends[:-1])
    spelled = np.logical_or.reduceat(letter[codes], starts)
    plain = to[codes]
    keep = _single_spaces(plain)
    keep[starts] = True  # the space before each text
    plain, after = plain[keep], np.cumsum(keep)
    ends = after[ends - 1]
    starts = np.append(0, ends[:-1])
    hashed = [_hashes(plain, n) for n in range(1, LONGEST + 1)]
    for i, a, b, letters in zip(part, starts, ends, spelled, strict=True):
        if letters:
            own = np.concatenate([h[a : max(a, b - n)] for n, h in enumerate(hashed)])
            own.sort(kind="stable")  # by radix, as the numbers are short
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            out[i] = own[first].astype(np.int32), np.diff(np.append(first, len(own))).astype(np.int32)


def _features(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    return (x / (np.sqrt((x * x).sum()) or 1.0)).astype(np.float32)


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, passes: int = PASSES, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """Weights (bucket x class, and a last row for the bias) of rows of (buckets, features, class)."""
    z, n = np.zeros((2, (1 << BITS) + 1, classes))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        w = -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2)
        return np.where(np.abs(zs) <= l1, 0.0, w)

    for _ in range(passes):
        for at, x, own in rows:
            at, x = np.append(at, 1 << BITS), np.append(x, 1.0)
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            p = _softmax(x @ w)
            p[own] -= 1.0
            g = x[:, None] * p[None, :]
            grown = ns + g * g
            z[at] = zs + g - (np.sqrt(grown) - np.sqrt(ns)) / alpha * w
            n[at] = grown
    return weights(z, n).astype(np.float32)


def fit_temperature(scores: np.ndarray, own: np.ndarray) -> float:
    """What scores are to be divided by for the least log loss on rows kept back; 1 if there are none. The loss has one minimum in 1/T.

    With n rows the right class counts (n + 1) / (n + 2) and the others share the rest, or rows that are all right would make every score certain.
    """
    rows, classes = scores.shape
    if not rows or classes < 2:
        return 1.0
    wanted = np.full(scores.shape, 1 / ((rows + 2) * (classes - 1)))
    wanted[np.arange(rows), own] = (rows + 1) / (rows + 2)

    def loss(log_t: float) -> float:
        s = scores / np.exp(log_t)
        top = s.max(1, keepdims=True)
        return ((np.log(np.exp(s - top).sum(1)) + top[:, 0]) - (wanted * s).sum(1)).mean()

    low, high, part = np.log(0.01), np.log(100.0), (5**0.5 - 1) / 2
    while high - low > 1e-4:
        a, b = high - part * (high - low), low + part * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _gather(rates: dict[str, float]):
    """A function over rows to learn from (lang, key, text): document counts of buckets, and the picked rows' buckets."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, seen = np.zeros(1 << BITS, np.int64), set()
        for batch in batches:
            picked: list[tuple] = []
            texts = batch.column("text").to_pylist()
            for lang, key, text, found in zip(batch.column("lang").to_pylist(), batch.column("key").to_pylist(), texts, buckets(texts), strict=True):
                if found is None:
                    continue
                docs[found[0]] += 1
                # the pick goes by the text too, so repeated ids are not all in or all out
                pick = zlib.crc32((text or "").encode("utf-8", "surrogatepass"), key)
                if pick < rates[lang] * 2**32 and (lang, pick) not in seen:
                    seen.add((lang, pick))
                    picked.append((lang, pick, found[0], found[1]))
            if picked:
                lang, pick, at, counts = zip(*picked, strict=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.string()), "pick": pa.array(pick, pa.int64()), "at": pa.array(at, pa.list_(pa.int32())), "n": pa.array(counts, pa.list_(pa.int32()))})
        if docs.any():
            some = np.flatnonzero(docs)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([None], pa.string()), "pick": pa.array([None], pa.int64()), "at": pa.array([some.astype(np.int32)], pa.list_(pa.int32())), "n": pa.array([docs[some].astype(np.int32)], pa.list_(pa.int32()))})

    return gather


def _train(names: list[str], idf: np.ndarray):
    """A function over the picked rows, all in one task: the model, as one row."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for lang, pick, at, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "pick", "at", "n")), strict=True):
                rows.append((pick, lang, np.array(at, np.int32), np.array(n, np.int32)))
        rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[1]))  # languages mixed, in an order that hashes fix
        ready = [(at, _features(at, n, idf), names.index(lang)) for _, lang, at, n in rows]
        learn, back = [r for i, r in enumerate(ready) if i % KEPT_BACK], [r for i, r in enumerate(ready) if i % KEPT_BACK == 0]
        w = fit_ftrl(learn or ready, len(names))
        scores = np.array([x @ w[at] + w[-1] for at, x, _ in back]).reshape(-1, len(names))
        t = fit_temperature(scores, np.array([r[2] for r in back], np.int64)) if learn else 1.0
        yield pa.RecordBatch.from_pydict({"weights": pa.array([w.tobytes()], pa.binary()), "temperature": pa.array([t])})

    return train


def fit(rows: DataFrame, bound: int = ROWS) -> tuple[list[str], np.ndarray, np.ndarray, float] | None:
    """Languages, inverse document frequencies, weights and temperature learnt from rows of lang, key (long) and text; None without rows.

    ``bound`` is the most rows that weights and temperature are fitted on; what comes to the driver are
    the languages, a number for each bucket, and the weights.
    """
    known = rows.filter(F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    names, share = sorted(sizes), max(1, bound // len(sizes))
    rates = {k: 2.0 * share / n for k, n in sizes.items()}  # twice as many as wanted; the window below keeps the bound
    texts = texts_for_python(known, F.col("lang"), F.col("key"), F.col("text"))
    found = materialize(texts.mapInArrow(_gather(rates), "lang string, pick long, at array<int>, n array<int>"), "language-rows")
    of = found.filter(F.col("lang").isNull()).select(F.inline(F.arrays_zip("at", "n")).alias("at", "n"))
    docs = np.zeros(1 << BITS)
    for r in of.groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
        docs[r["at"]] = r["n"]
    idf = (np.log((1 + sum(sizes.values())) / (1 + docs)) + 1).astype(np.float32)
    best = F.row_number().over(Window.partitionBy("lang").orderBy("pick"))
    sample = found.filter(F.col("lang").isNotNull()).withColumn("__n", best).filter(F.col("__n") <= share).drop("__n")
    model = sample.coalesce(1).mapInArrow(_train(names, idf), "weights binary, temperature double").first()
    return names, idf, np.frombuffer(model["weights"], np.float32).reshape(-1, len(names)), model["temperature"]


def predictions(documents: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = (), bound: int = ROWS) -> DataFrame:
    """doc_id, lang_pred, score (the calibrated probability of the language) and the columns ``keep`` of every row, learnt from the rows where ``learn`` holds."""
    key = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    taught = documents.filter(learn).select(F.col(lang_col).cast("string").alias("lang"), key.alias("key"), F.col(text_col).alias("text"))
    model = fit(taught, bound)
    out_schema = documents.select(F.col(id_col).alias("doc_id"), *keep).schema

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for found in buckets(batch.column("__text").to_pylist()):
                if found is None or model is None:
                    langs.append(UNDETERMINED), scores.append(0.0)
                    continue
                names, idf, weights, temperature = model
                at, counts = found
                p = _softmax((_features(at, counts, idf) @ weights[at] + weights[-1]).astype(float) / temperature)
                langs.append(names[best := int(p.argmax())]), scores.append(float(p[best]))
            columns = [batch.column(c) for c in ("doc_id", *keep)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", *keep, "lang_pred", "score"])

    rows = texts_for_python(documents, F.col(id_col).alias("doc_id"), *map(F.col, keep), F.col(text_col).alias("__text"))
    return rows.mapInArrow(predict, out_schema.add("lang_pred", "string").add("score", "double"))
