"""Tokens, packing, token files, counts, SimHash, toxicity, the lattice and the pipeline, against brute force."""

import bisect
import math
import random
import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from footfall.llm import coder, common, counts, golay, lattice, packing, simhash, tokenfile, tokens, toxicity

WORD_BPE = tokens.default_tokenizer()
ODD = ["", None, "  ", "It's we'll don't 123 4a5 <|endoftext|> x<|startoftext|>y", "ÀÉÎ ß İstanbul ΣΑΣ ﬁ ñ é 漢字かな 😀👍🏽", "a\u0085b \x1c\x1dz x́", "_a_ ×÷² ½ ªº", "A" * 3000, "a b", "a b"]


def table(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", 3, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string, length int, ids string")


@pytest.fixture(scope="module")
def reference():
    return tokens.WordEncoder(WORD_BPE).whole


def ids_of(reference, text):
    return reference.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizers(reference):
    own = tokens.WordEncoder(WORD_BPE)
    texts = [t or "" for t in ODD]
    for _ in range(2):  # the second time from the memo
        ids, at = own.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [ids_of(reference, t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=6))
def test_ids_equal_the_tokenizers_on_any_text(texts):
    own = tokens.encoder(WORD_BPE)
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, at = own.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [own.whole.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize(("capacity", "n"), [(1, 5), (10, 60), (64, 500), (4096, 400)])
def test_plan_is_best_fit_decreasing(capacity, n):
    rng = random.Random(capacity)
    lengths = [max(1, min(capacity, int(rng.expovariate(3 / capacity)))) for _ in range(n)]
    held = {k: lengths.count(k) for k in set(lengths)}
    plan = packing.best_fit_plan(held, capacity)
    room, bins = [], 0
    for k in sorted(lengths, reverse=True):
        i = bisect.bisect_left(room, k)
        left = room.pop(i) if i < len(room) else capacity
        bins += left == capacity
        bisect.insort(room, left - k)
    assert max(r[3] + -(-r[2] // r[4]) for r in plan) == bins


def test_packing_places_every_id_once(spark, reference):
    texts = [*ODD, *(" ".join(["word"] * random.Random(i).randrange(1, 60)) for i in range(60))]
    docs = table(spark, texts).unionByName(table(spark, ["a b"], 8)).unionByName(table(spark, ["n"]).withColumn("doc_id", F.lit(None).cast("long")))
    items = packing.pieces(tokens.token_ids(docs, end_id=1), 16).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("crc"))
    got = packing.pack(items, 16).toPandas()
    want = sum(len(ids_of(reference, r["text"])) + 1 for r in docs.collect())
    assert got.length.sum() == want and got.length.max() <= 16
    for _, one in got.sort_values("offset").groupby("sequence_id"):
        assert (one.offset.to_numpy() == np.cumsum(one.length) - one.length).all() and one.length.sum() <= 16
    for _, one in got[got.doc_id == 3].sort_values("piece").groupby("doc_id"):
        whole = [*ids_of(reference, ODD[3]), 1]
        assert [zlib.crc32(np.array(whole[s : s + n], "<u4").tobytes()) for s, n in zip(one.start, one.length, strict=True)] == one.crc.tolist()
    assert packing.pack(items.limit(0), 16).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 70000), max_size=2000))
def test_coder_round_trip(ids):
    ids = np.array(ids, "<u4")
    assert (coder.decode_block(coder.encode_block(ids)) == ids).all()


def test_coder_compresses_and_notices_damage():
    rng = np.random.default_rng(0)
    ids = np.repeat(rng.zipf(1.4, 30000) % 40000, 2).astype("<u4")
    block = coder.encode_block(ids)
    assert (coder.decode_block(block) == ids).all() and len(block) < 1.5 * len(ids)
    for at in (9, len(block) // 2):
        damaged = bytearray(block)
        damaged[at] ^= 16
        with pytest.raises(ValueError):
            coder.decode_block(bytes(damaged))


@pytest.mark.parametrize("block_ids", [7, 1 << 20])
def test_token_files_round_trip(spark, reference, block_ids):
    docs = table(spark, ODD).unionByName(table(spark, ["n"]).withColumn("doc_id", F.lit(None).cast("long"))).repartition(3)
    path = f"{common.shared_dir(spark)}/t-{uuid.uuid4().hex}"
    tokenfile.write_token_files(docs, path, end_id=2, block_ids=block_ids)
    start = 0
    for r, (i, t) in zip(tokenfile.read_token_files(spark, path).orderBy("start").collect(), [(None, "n"), *enumerate(ODD)], strict=True):
        want = np.array([*ids_of(reference, t), 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) == (i, start, len(want), want.tobytes())
        start += len(want)


def test_token_files_of_an_empty_table(spark):
    path = f"{common.shared_dir(spark)}/t-{uuid.uuid4().hex}"
    tokenfile.write_token_files(table(spark, ["x"]).limit(0), path)
    assert tokenfile.read_token_files(spark, path).count() == 0


@pytest.mark.parametrize("block_ids", [1, 3, 1 << 18])
def test_counts_from_flat_files(spark, reference, block_ids):
    docs = table(spark, ODD).repartition(3, F.rand())  # another order each time it is read
    for file_bytes in (1, 30, 1 << 24):
        path = f"{common.shared_dir(spark)}/f-{uuid.uuid4().hex}"
        counts.write_flat(docs, path, file_bytes=file_bytes)
        got = sorted((r["doc_id"], r["n_tokens"]) for r in counts.token_counts(spark, path, block_ids=block_ids).collect())
        assert got == [(i, len(ids_of(reference, t))) for i, t in enumerate(ODD)]


def test_counts_of_null_and_repeated_ids_and_of_nothing(spark, reference):
    docs = spark.createDataFrame([(None, "a b"), (1, "c"), (1, "d e f"), (None, None)], "doc_id long, text string")
    path = f"{common.shared_dir(spark)}/f-{uuid.uuid4().hex}"
    counts.write_flat(docs, path)
    got = Counter((r["doc_id"], r["n_tokens"]) for r in counts.token_counts(spark, path).collect())
    assert got == Counter([(None, 2), (1, 1), (1, 3), (None, 0)])
    counts.write_flat(docs.limit(0), path + "-none")
    assert counts.token_counts(spark, path + "-none").count() == 0


def test_no_file_outgrows_its_bound(spark):
    """Ends and names count too: empty documents with long ids are bytes as well."""
    docs = table(spark, [""] * 2000 + ["a b c"] * 50, first=10**15).repartition(2)
    path = f"{common.shared_dir(spark)}/flat-{uuid.uuid4().hex}"
    counts.write_flat(docs, path, file_bytes=1000)
    for kind in (counts.FLAT, counts.NAMES):
        sizes = [r["n"] for r in counts._files(spark, path, kind).select(F.length("content").alias("n")).collect()]
        assert len(sizes) > 30 and max(sizes) <= 1002  # and the end after a list of names
    got = Counter(r["n_tokens"] for r in counts.token_counts(spark, path).collect())
    assert sum(got.values()) == 2050 and got[0] == 2000


def test_stitching_over_files_and_blocks(spark):
    rng = np.random.default_rng(2)
    stream = np.where(rng.random(400) < 0.06, 9, 1)
    files = [stream[:3], stream[3:5], stream[5:200], stream[200:201], stream[201:]]
    rows = []
    for part, ids in enumerate(files):
        for k in range(-(-len(ids) // 4)):
            block = ids[4 * k : 4 * k + 4]
            ends = np.flatnonzero(block == 9)
            some = len(ends) > 0
            rows.append((part, k, len(ends), int(ends[0]) if some else 0, int(len(block) - 1 - ends[-1]) if some else len(block), [int(x) for x in np.diff(ends) - 1]))
    blocks = spark.createDataFrame(rows, "part int, block int, ends long, head long, tail long, inner array<long>")
    got = counts.stitch(blocks).orderBy(F.col("part").asc_nulls_last(), "nth").collect()
    at = np.flatnonzero(stream == 9)
    want = np.diff(np.concatenate([[-1], at])) - 1
    assert [r["n_tokens"] for r in got] == [*want.tolist(), *([len(stream) - 1 - at[-1]] if at[-1] < len(stream) - 1 else [])]


def brute_fingerprint(text):
    from xxhash import xxh64

    own = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not own:
        return 0
    hashes = [xxh64(" ".join(own[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(own) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(spark):
    rng = random.Random(5)
    texts = [*ODD]
    for _ in range(12):
        base = [f"w{rng.randrange(50)}" for _ in range(rng.choice([2, 3, 40, 200]))]
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "X"
            texts.append(" ".join(copy))
    docs = table(spark, texts, 100)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs.repartition(5)).collect()}
    prints = {100 + i: brute_fingerprint(t) for i, t in enumerate(texts)}
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    for i in prints:
        assert got[i]["fp"] % (1 << 64) == prints[i] and got[i]["component_id"] == find(i)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_links_are_found_exactly_once(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    many = [base]
    for flips in (1, 2, 3, 3, 4):
        near = base.copy()
        for _ in range(flips):
            near ^= np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)
        many.append(near)
    fps = np.unique(np.concatenate(many))
    got = simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")).collect()
    want = {tuple(sorted((int(a), int(b)))) for i, a in enumerate(fps.view(np.int64)) for b in fps.view(np.int64)[i + 1 :] if (int(a) ^ int(b)) % (1 << 64) != 0 and ((int(a) ^ int(b)) % (1 << 64)).bit_count() <= 3}
    assert sorted((r["a"], r["b"]) for r in got) == sorted(want)


def test_golay_code_is_perfect_and_links_two_errors():
    assert len(np.unique(golay.nearest_table())) == 4096 and (np.bincount(golay.nearest_table()) == 2048).all()
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 2000)
    other = words ^ (1 << rng.integers(0, 23, 2000)) ^ (1 << rng.integers(0, 23, 2000))
    assert (golay.nearby(words)[:, :, None] == golay.nearby(other)[:, None, :]).any((1, 2)).all()


def test_components_of_long_chains(spark):
    rng = random.Random(1)
    nodes = list(range(60))
    rng.shuffle(nodes)
    edges = [*zip(nodes[:40], nodes[1:40], strict=False), *zip(nodes[40:], nodes[41:], strict=False)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: min(nodes[:40]) for n in nodes[:40]} | {n: min(nodes[40:]) for n in nodes[40:]}


def test_toxicity_learns_words_and_pairs(spark):
    rng = random.Random(0)
    docs, labels = [], []
    for i in range(900):
        text = [f"w{rng.randrange(300)}" for _ in range(40)]
        bad = i % 6 == 0
        if bad and i % 12:
            text[3] = rng.choice(["rotten", "Vile!", "foul,"])
        elif bad:
            text[3], text[9] = f"zorg{rng.randrange(30)}", f"zorg{rng.randrange(30)}"
        elif i % 6 == 1:
            text[5] = f"zorg{rng.randrange(30)}"
        docs.append((i, " ".join(text), 1.0, "x"))
        labels.append((i, 1, int(bad)))
    docs += [(900, None, 1.0, "x"), (901, "", 1.0, "x"), (902, "!!! " * 50, 1.0, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score double, toxic string")
    gold = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["toxicity_score"] for r in toxicity.toxicity(df, gold).collect()}
    assert len(got) == 903 and all(0 <= v <= 1 for v in got.values()) and got[900] == got[901] < 0.5
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 6 == 0) for i in held) >= 0.95 * len(held)
    assert max(r["toxicity_score"] for r in toxicity.toxicity(df, gold.limit(0)).collect()) < 0.01


def test_label_model_discounts_voters_that_repeat_one_another():
    rng = np.random.default_rng(0)
    gold = (rng.random(2000) < 0.3).astype(float)
    good = [np.where(rng.random(2000) < 0.9, gold, 1 - gold) for _ in range(3)]
    noise = (rng.random(2000) < 0.5).astype(float)
    votes = np.stack([*good, *[noise] * 10], 1)
    p = toxicity.label_model(votes, np.full(2000, 0.5) + 0.2 * (good[0] - 0.5))
    assert ((p > 0.5) == (gold == 1)).mean() > 0.9


def brute_lattice(pieces, longest, word):
    t, best = lattice.MARK + word, [0.0]
    for j in range(1, len(t) + 1):
        parts = []
        for i in range(max(0, j - longest), j):
            s = t[i:j]
            if s in pieces and not (len(s) == 6 and s.startswith("<0x")):
                parts.append(best[i] + pieces[s])
            elif len(s) == 1:
                parts.append(best[i] + sum(pieces[f"<0x{b:02X}>"] for b in s.encode()))
        best.append(np.logaddexp.reduce(parts))
    return best[-1]


def test_lattice_sums_all_segmentations():
    pieces, logp = lattice.vocabulary(lattice.default_vocabulary())
    own = lattice.Lattice(pieces, logp)
    words = ["the", "erion", "ébleea", "漢字x", "a", "", "<0x41>", "x" * 50, "thandhein,", "😀"]
    brute = dict(zip(pieces, logp, strict=True))
    score, expected = own.run(words, np.ones((len(words), 1)))
    expected = expected[:, 0]
    assert np.allclose(score, [brute_lattice(brute, own.longest, w) for w in words])
    spelt = sum(len(pieces[i]) * n for i, n in enumerate(expected) if not pieces[i].startswith("<0x"))
    by_bytes = sum(c not in brute for w in words for c in w)
    assert spelt == pytest.approx(sum(len(w) + 1 for w in words) - by_bytes, abs=1e-6)


def test_expected_pieces_equal_all_segmentations():
    pieces, logp = lattice.vocabulary(lattice.default_vocabulary())
    index = {p: i for i, p in enumerate(pieces)}
    words = ["then", "nine", "漢", "aa"]

    def cuts(t):
        if not t:
            yield []
        for k in range(1, len(t) + 1):
            if t[:k] in index and t[:k] != lattice.END:
                yield from ([index[t[:k]], *rest] for rest in cuts(t[k:]))
            elif k == 1:
                yield from ([*(index[f"<0x{b:02X}>"] for b in t[:1].encode()), *rest] for rest in cuts(t[1:]))

    want = np.zeros(len(pieces))
    for w in words:
        ways = list(cuts(lattice.MARK + w))
        p = np.array([np.exp(logp[way].sum()) for way in ways])
        for way, share in zip(ways, p / p.sum(), strict=True):
            np.add.at(want, way, share)
    assert np.allclose(lattice.Lattice(pieces, logp).run(words, np.ones((4, 1)))[1][:, 0], want, atol=1e-9)


def test_lattice_score_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lattice, "MAX_CLASSES", 1)
    rng = random.Random(8)
    known = ["then", "nine", "over", "ébène", "漢字", "x1,", "rare"]
    rows = [(i, " ".join(rng.choices(known[: 5 + i % 3], k=rng.randrange(1, 9))) if i else None, ["en", "fr", None][i % 3] if i % 4 else "en", i % 5 != 1) for i in range(40)]
    rows.append((40, "unseen then 漢 漢", "en", False))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, train boolean")
    pieces, logp = lattice.vocabulary(lattice.default_vocabulary())
    words_in = lambda t: [*(t or "").split(), lattice.END]
    own = lambda r: 0 if r[2] == "en" else 1
    counts = [Counter(w for r in rows if r[3] and (k is None or own(r) == k) for w in words_in(r[1])) for k in (None, 0, 1)]
    table_ = spark.createDataFrame([(w, c, counts[1][w], counts[2][w]) for w, c in counts[0].items()], "word string, c long, c0 long, c1 long")
    logp, of_class = lattice.estimate(table_, pieces, logp, 2, ["c0", "c1"])
    sums, once = [sum(c.values()) for c in counts], [1 + sum(n == 1 for n in c.values()) for c in counts]
    texts = [c[lattice.END] for c in counts]
    longest = lattice.Lattice(pieces, logp).longest

    def log_p(w, k):
        model = dict(zip(pieces, of_class[k], strict=True))
        q = math.exp(model[w] if w == lattice.END else brute_lattice(model, longest, w))
        p = (counts[0][w] + once[0] * q) / (sums[0] + once[0])
        return math.log10((counts[k + 1][w] + once[k + 1] * p) / (sums[k + 1] + once[k + 1]))

    for hot in (100_000, 2):
        got = {r["doc_id"]: r["score"] for r in lattice.lattice_scores(docs, class_col="lang", hot_words=hot).collect()}
        for r in rows:
            each = [math.log10(texts[k + 1] / texts[0]) + sum(log_p(w, k) for w in words_in(r[1])) for k in (0, 1)]
            top = max(each)
            assert got[r[0]] == pytest.approx(top + math.log10(sum(10 ** (x - top) for x in each)), abs=1e-6)


def test_lattice_scores_on_edge_texts(spark):
    texts = [*ODD, "the cat sat", "THE cat  ran\n", "zzz qqq"]
    docs = table(spark, texts).withColumn("train", F.col("doc_id") % 2 == 0).repartition(3)
    for hot in (100_000, 2):
        got = {r["doc_id"]: r for r in lattice.lattice_scores(docs, class_col="lang", rounds=1, hot_words=hot).collect()}
        held = {}
        for i, t in enumerate(texts):
            held[i] = [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})), " "]
        seen = [w for i in held if i % 2 == 0 for w in held[i]]
        n, v = len(seen), len(set(seen))
        for i, own in held.items():
            base = sum(math.log10((seen.count(w) + 0.5) / (n + 0.5 * (v + 1))) for w in own)
            assert got[i]["base_score"] == pytest.approx(base) and got[i]["n_tokens"] == len(own) and got[i]["n_known"] == sum(w in seen for w in own)
            assert got[i]["train_tokens"] == n and -1e6 < got[i]["score"] < 0
    assert lattice.lattice_scores(docs.limit(0), rounds=1).count() == 0
