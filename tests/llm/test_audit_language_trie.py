"""Source divergence, language identification and the conversation trie, against brute force and SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from footfall.llm import divergence, langid, queries, trie

DATA = Path("/root/testdata/sf0.001")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars int, term string, n long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, "x", 7) for i, (t, lang, s) in enumerate(rows)], DOCUMENTS)


def brute_audit(rows, min_docs=3, top=200):
    word = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [t.translate(lower) for t in word.findall(text or "")]
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in seen[lang].items() if n >= min_docs)
        own = sorted(s for g, s in groups if g == lang)

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in own}
        q = shares(sum((counts[lang, s] for s in own), Counter()))
        for s in own:
            pairs = [(x, sum((p[s][t] - p[x][t]) ** 2 // p[x][t] for t in kept)) for x in own if x != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


def audit(df, **kwargs):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.divergence(df, **kwargs).collect())


def test_audit_equals_brute_force(spark):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in ("Ab", "é", "x", "ÀB", "漢") for b in "abcdefgh"]
    rows = []
    for i in range(220):
        lang, source = rng.choice(["en", "de", None]), f"s{min(rng.randrange(9), rng.randrange(9))}" if i % 7 else None
        rows.append((" ".join(rng.choices(words, rng.choices([1, 5, 20], k=len(words)), k=rng.randrange(60))) + rng.choice(["", "1x_y-z", "\n[Ab]"]), lang, source))
    rows += [(None, "en", "empty"), ("", "en", "empty2"), ("alone", "solo", "a"), ("x", "none", "a"), ("y", "none", "b"), rows[3], rows[3], ("k" * 70_000 + " xa", "en", "s1")]
    want = brute_audit(rows)
    df = documents(spark, rows)
    assert audit(df) == want and {w[2] for w in want} == {"pair", "term"}
    assert audit(df.repartition(9), top=3) == brute_audit(rows, top=3)
    assert audit(df, min_docs=1) == brute_audit(rows, min_docs=1)
    assert audit(df.limit(0)) == []


def test_audit_in_small_blocks_and_accumulators(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(" ".join(rng.choices("abcdefghijklmnop", k=20)), rng.choice("xy"), rng.choice("123456")) for _ in range(120)]
    index = [(lang, np.array(sorted(rng.sample(range(6), rng.randrange(1, 7)))), np.array([rng.randrange(1, 9) for _ in range(6)])) for lang in ["x"] * 40 + ["y"] * 30]
    import pyarrow as pa

    def summed(posts, numbers):
        monkeypatch.setattr(divergence, "POSTINGS_HELD", posts)
        monkeypatch.setattr(divergence, "NUMBERS_HELD", numbers)
        langs = {k: (50, np.arange(10, 70, 10)) for k in "xy"}
        total = Counter()
        part = [pa.RecordBatch.from_pydict({"lang": [x[0] for x in index[a : a + 7]], "numbers": pa.array([x[1] for x in index[a : a + 7]], pa.list_(pa.int32())), "counts": pa.array([x[2][: len(x[1])] for x in index[a : a + 7]], pa.list_(pa.int64()))}) for a in range(0, 70, 7)]
        for batch in divergence._scatterer(langs)(iter(part)):
            for r in batch.to_pylist():
                total[r["lang"], r["p_group"], r["q_group"]] += r["value"]
        return {k: v for k, v in total.items() if v}

    assert summed(1, 1) == summed(50, 10) == summed(10**6, 10**6)
    monkeypatch.setattr(divergence, "TERMS_HELD", 5)
    assert audit(documents(spark, rows)) == brute_audit(rows)


def test_shares_are_exact_for_large_counts(spark):
    rng = random.Random(3)
    cases = [(c := rng.randrange(10**13), c + rng.randrange(10**14), rng.randrange(1, 10**9)) for _ in range(300)] + [(0, 0, 1), (0, 10**14, 10**9), (10**14, 10**14, 1)]
    want = [1 + 10**9 * (c + 1) // (n + v) for c, n, v in cases]
    df = spark.createDataFrame(cases, "c long, n long, v long").select(divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert [r["p"] for r in df.collect()] == want
    assert [int(divergence._share(np.array([c]), np.array([n]), v)[0]) for c, n, v in cases] == want


def rebuilt(turns):
    """conv_id to its turns, rebuilt as the query does."""
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), text or ""))
    own = {c: [(r, x) for *_, r, _, x in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + ts[h:]
    return out


def brute_trie(seqs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in seqs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
        ends[tuple(ts)].append(c)
    below = {k: [o for o in members if o[: len(k)] == k] for k in members}
    out = []
    for k, cs in members.items():
        def saved(o):
            return (len(members[o]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", o[-1][1])) if o else 0

        children = [o for o in below[k] if len(o) == len(k) + 1]
        leaves = sum(not any(len(x) == len(o) + 1 for x in below[o]) for o in below[k])
        sha = hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
        out.append((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), len(children), leaves, sum(map(saved, below[k])), sha))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id long, turn long, role string, text string, words int, head string"


def conversations(spark, turns):
    return spark.createDataFrame([(*t, 1, "x") for t in turns], TURNS)


def nodes_of(df, limit=None):
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    return sorted(map(tuple, trie.trie(trie.with_shared_heads(df, 20, head, 3), limit).select(COLUMNS).collect()), key=str)


@pytest.mark.parametrize("limit", [None, 1, 3])
def test_trie_equals_brute_force(spark, limit):
    rng = random.Random(5)
    said = ["a b", "", None, "c\td  e", "a b\n"]
    turns = []
    for conv in [*range(0, 70), 100, 121, 2000, 2001, 99_999]:
        kind = rng.randrange(4)
        n = rng.choice([1, 2, 3, 5, 8])
        for t in range(n):
            text = said[t % 5] if kind < 2 else rng.choice(said)
            turns.append((conv, None if t == 0 and conv % 9 == 0 else t, rng.choice(["user", None]) if kind == 3 else "user", text))
    turns += [(5, 3, "user", "tie b"), (5, 3, "user", "tie a"), (5, 3, "user", "tie a"), (None, 1, "user", "nobody"), (41, 0, "user", "only")]
    rng.shuffle(turns)
    want = brute_trie(rebuilt(turns))
    assert nodes_of(conversations(spark, turns).repartition(5), limit) == want


def test_trie_of_copies_long_conversations_and_nothing(spark):
    turns = [(c * 20, t, "user", f"turn {t}") for c in range(60) for t in range(3)] + [(c * 20, t, "user", f"own {t}") for c in (70, 71) for t in range(150)] + [(1400, 150, "user", "more")]
    turns += [(1440, t, "user", f"own {t}") for t in range(70)]
    want = brute_trie(rebuilt(turns))
    for limit in (2, 1000):
        assert nodes_of(conversations(spark, turns), limit) == want
    assert nodes_of(conversations(spark, turns).limit(0)) == []
    seqs = trie.sequences(conversations(spark, [(1, 0, "user", "x"), (2, 0, "user", "x"), (2, 1, "user", "y")]))
    last = trie.last_turns(trie.trie(seqs), seqs).collect()
    assert sorted((r["depth"], r["turn_id"] is None) for r in last) == [(0, True), (1, False), (2, False)]


def test_buckets_equal_brute_force(monkeypatch):
    rng = random.Random(7)
    texts = [None, "", "  ", "12 34!", "a", "É", "Ab  cD\n\nef9gh", " x ", "ß İ ǅ é", "漢字 かな", "́ 1"]
    texts += ["".join(rng.choices("abcXYZ é9 .", k=rng.randrange(300))) for _ in range(60)]
    to, letter = langid._plain()

    def brute(text):
        if not any(c.isalpha() for c in text or ""):
            return None
        plain = re.sub(" +", " ", " " + "".join(chr(to[ord(c)]) for c in text))
        found = Counter()
        for n in (1, 2, 3):
            for i in range(len(plain) - n + 1):
                found[int(langid._hashes(np.array([ord(c) for c in plain[i : i + n]], np.uint32), n)[0])] += 1
        return dict(found)

    for at_once in (1_000_000, 50, 7):
        monkeypatch.setattr(langid, "AT_ONCE", at_once)
        got = langid.buckets(texts)
        assert [None if g is None else dict(zip(g[0].tolist(), g[1].tolist(), strict=True)) for g in got] == [brute(t) for t in texts]
        assert all(g is None or (np.diff(g[0]) > 0).all() for g in got)


def test_regression_is_sparse_and_its_temperature_is_the_best():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(400):
        own = int(rng.integers(3))
        at = np.unique(np.append(rng.integers(100, 400, 20), own * 7 + rng.integers(0, 5, 3))).astype(np.int32)
        rows.append((at, np.full(len(at), 1 / np.sqrt(len(at)), np.float32), own))
    w = langid.fit_ftrl(rows, 3)
    right = np.mean([(x @ w[at] + w[-1]).argmax() == own for at, x, own in rows])
    assert right > 0.95 and not w[500:-1].any()
    strong = langid.fit_ftrl(rows, 3, l1=0.5)
    assert (strong != 0).sum() < 0.5 * (w != 0).sum()
    assert np.abs(langid.fit_ftrl(rows, 3, l2=50.0)).max() < np.abs(w).max()
    scores, own = rng.normal(size=(500, 3)) * 4, rng.integers(0, 3, 500)
    scores[np.arange(500), own] += 2.0
    t = langid.fit_temperature(scores, own)

    def loss(t):
        return -np.log(langid._softmax(scores / t)[np.arange(500), own]).mean()

    assert all(loss(t) <= loss(t * f) + 1e-4 for f in (0.8, 0.95, 1.05, 1.3)) and t > 1.5
    assert langid.fit_temperature(scores[:0], own[:0]) == 1.0 and langid.fit_temperature(np.eye(3) * 9, np.arange(3)) > 0.2


def spelled(rng, letters, n):
    return " ".join("".join(rng.choices(letters, k=rng.randrange(2, 8))) for _ in range(n))


def test_languages_of_held_out_texts_and_edges(spark):
    rng = random.Random(9)
    kinds = {"aa": "abcdefé", "bb": "defghij", "cc": "klmnoab"}
    rows = [(i, spelled(rng, kinds[lang], rng.choice([3, 10, 60])), lang if i % 17 else None, i % 3 != 1, "x", 1.0) for i in range(600) for lang in [rng.choice(list(kinds))]]
    truth = {}
    for i, text, lang, learn, *_ in rows:
        if lang is not None:
            truth[i] = lang
    rows += [(1000, None, "aa", True, "x", 1.0), (1001, "", "zz", False, "x", 1.0), (1002, "12 !?", "aa", True, "x", 1.0), (None, "abcé abc", None, False, "x", 1.0), (1003, "ABCÉ fedcba " * 40_000, "aa", False, "x", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, learn boolean, lang_pred string, score double")
    got = {r["doc_id"]: r for r in langid.predictions(df, F.col("learn"), keep=("learn",)).collect()}
    held = [i for i, lang in truth.items() if i % 3 == 1]
    assert len(got) == len(rows) and np.mean([got[i]["lang_pred"] == truth[i] for i in held]) > 0.97
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0.0 for i in (1000, 1001, 1002))
    assert got[None]["lang_pred"] == got[1003]["lang_pred"] == "aa" and all(0 <= r["score"] <= 1 for r in got.values())
    again = {r["doc_id"]: r["score"] for r in langid.predictions(df.repartition(7), F.col("learn")).collect()}
    assert all(again[i] == pytest.approx(got[i]["score"], abs=1e-4) for i in again)
    few = langid.predictions(df, F.col("learn"), bound=90).collect()
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in few if r["doc_id"] in held]) > 0.85
    alone = langid.predictions(df, F.col("learn") & (F.col("lang") == "aa")).collect()
    assert {(r["lang_pred"], r["score"]) for r in alone} == {("aa", 1.0), ("und", 0.0)}
    assert {r["lang_pred"] for r in langid.predictions(df, F.lit(False)).collect()} == {"und"}
    assert langid.predictions(df.limit(0), F.col("learn")).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_source_divergence", "op13_conversation_trie"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = queries.queries()[name](spark, str(DATA)).toPandas()
    want = con.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = [sorted(tuple(None if v != v else v for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)) for df in (got, want)] if name.startswith("op11") else [sorted(map(str, df[sorted(df.columns)].astype({"parent_conv_id": "Int64"}).itertuples(index=False))) for df in (got, want)]
    assert plain[0] == plain[1]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_the_language_query_is_right_where_it_did_not_learn(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.op12_language_id(spark, str(DATA)).collect()
    held = [r for r in got if r["held_out"] and truth[r["doc_id"]] is not None]
    assert len(got) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95
