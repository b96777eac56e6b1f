"""Fingerprints, chat formatting, sharding and decontamination on small tables, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from footfall.llm import chat, decontam, fingerprint, queries, sharding

DOCS = "doc_id long, text string, lang string, bucket int, range int"


def documents(spark, texts, first=0):
    """With extra columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(first + i, t, None, 1, 2) for i, t in enumerate(texts)], DOCS)


TEXTS = ["", None, "   \n \t", "one line only", "Same text.\nTwo lines of it here.", "Same text.\nTwo lines of it here.", "ü漢😀 mixed, text; with\nmany marks.\n\nAnd gaps", "w " * 30000, "last one"]


def test_next_document_by_id(spark):
    docs = documents(spark, TEXTS)
    for size in (1, 3, 1000):
        got = [(r["doc_id"], r["next_text"]) for r in fingerprint.with_next(docs.repartition(5), "doc_id", "text", rows_per_range=size, max_cuts=2 if size == 3 else 1024).orderBy("doc_id").collect()]
        assert got == [(i, TEXTS[(i + 1) % len(TEXTS)] or "") for i in range(len(TEXTS))]
    ties = spark.createDataFrame([(5, "b"), (5, "a"), (None, "n"), (7, "z")], "doc_id long, text string")
    got = sorted((r["text"], r["next_text"]) for r in fingerprint.with_next(ties, "doc_id", "text").collect())
    assert got == [("a", "b"), ("b", "z"), ("n", "a"), ("z", "n")]
    assert fingerprint.with_next(docs.limit(0), "doc_id", "text").count() == 0


def test_next_document_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGES_TOGETHER", 3)
    ids = [k * k for k in range(40)]
    docs = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string").repartition(7)
    got = dict(tuple(r) for r in fingerprint.with_next(docs, "doc_id", "text", rows_per_range=2, max_cuts=8).select("text", "next_text").collect())
    assert got == {str(a): str(b) for a, b in zip(ids, ids[1:] + ids[:1], strict=True)}


def test_fingerprints_say_equality_and_place(spark):
    docs = documents(spark, TEXTS)
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(docs).collect()}
    for i, a in enumerate(TEXTS):
        for j, b in enumerate(TEXTS):
            assert (prints[i] == prints[j]) == ((a or "") == (b or ""))
    before = documents(spark, ["a\nb\nc\nd", "same"])
    after = documents(spark, ["a\nb2\nc\nd", "same"])
    got = fingerprint.locate_edits(fingerprint.fingerprints(before), fingerprint.fingerprints(after)).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 1)]


def brute_tree(text):
    """Leaves by paragraph, and the root."""
    cuts = [re.sub("([n.,;:!?|)][ \t\r\f\v]+)", "\\1\1", line).split("\1") for line in text.split("\n")]
    lines = [[hashlib.md5(((p[i - 1] if i else "") + "\1" + x if x else "").encode()).hexdigest()[:16] for i, x in enumerate(p)] for p in cuts]
    sections, own = [], []
    for leaves in lines:
        own.append(hashlib.sha256(" ".join(leaves).encode()).hexdigest())
        if own[-1] < "4":
            sections, own = [*sections, own], []
    sections += [own] if own else []
    nodes = [hashlib.sha256(" ".join(x).encode()).hexdigest() for x in sections]
    return lines, hashlib.sha256("".join(nodes).encode()).hexdigest()


def brute_likeness(a, b):
    (x, root_x), (y, root_y) = brute_tree(a), brute_tree(b)
    nothing = hashlib.md5(b"").hexdigest()[:16]
    x, y = (Counter(leaf for p in t for leaf in p if leaf != nothing) for t in (x, y))
    return (2 * sum((x & y).values()) + 2 * (root_x == root_y)) / (sum(x.values()) + sum(y.values()) + 2)


def variants():
    rng = random.Random(5)
    say = ["that is, then, a word.", "an order; not in time", "", "other sun! or", "not in time in time in time", "\x01 odd in\x01 fact", "a | b"]
    for n in (1, 2, 9, 60):
        lines = [rng.choice(say) + f" of {rng.randrange(4)}" * rng.randrange(2) for _ in range(n)]
        k = rng.randrange(n)
        yield lines, lines
        yield lines, lines[:k] + lines[k + 1 :]
        yield lines, lines[::-1]
        yield lines, [*lines[:k], "put in, new", *lines[k:]]
        yield lines, lines + lines
        yield lines, [x if i != k else x + " and more" for i, x in enumerate(lines)]
        yield [*lines, *lines[:k]], [*lines[k:], *lines]


def test_likeness_and_edits_equal_brute_force(spark):
    pairs = [("\n".join(a), "\n".join(b)) for a, b in variants()]
    pairs += [("", ""), ("", " \t"), (" ", "a b"), ("x, y", "x, x, y"), ("w in " * 4000, "w in " * 3999), ("n n n n", "n n n")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "doc_id long, a string, b string")
    trees = df.select("doc_id", fingerprint.tree(F.col("a")).alias("a"), fingerprint.tree(F.col("b")).alias("b"))
    got = {r["doc_id"]: r for r in trees.select("doc_id", fingerprint.root(F.col("a")).alias("root"), fingerprint.likeness(F.col("a"), F.col("b")).alias("like"), fingerprint.likeness(F.col("b"), F.col("a")).alias("back")).collect()}
    before, after = (fingerprint.fingerprints(df, text_col=c) for c in "ab")
    edits = {r["doc_id"]: tuple(r)[1:] for r in fingerprint.locate_edits(before, after).collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[i]["root"] == brute_tree(a)[1]
        assert got[i]["like"] == pytest.approx(brute_likeness(a, b), abs=1e-12) and got[i]["back"] == pytest.approx(got[i]["like"], abs=1e-12)
        assert (got[i]["like"] == 1) == (a == b) == (i not in edits)
        if a != b:
            x, y = a.split("\n"), b.split("\n")
            first = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
            last = next((k for k in range(min(len(x), len(y)) - first) if x[-1 - k] != y[-1 - k]), min(len(x), len(y)) - first)
            at, removed, added = edits[i]
            assert (removed, added) == (len(x) - first - last, len(y) - first - last) and at <= first
            assert x[:at] == y[:at] and x[at + removed :] == y[at + added :]


def test_sections_of_a_tree_are_local(spark):
    lines = [f"line number {i}" for i in range(200)]
    changed = [*lines[:100], "another", *lines[101:]]
    a, b = (fingerprint.fingerprints(documents(spark, ["\n".join(x)])).first()["sections"] for x in (lines, changed))
    assert 1 <= len(set(a) ^ set(b)) <= 6 and len(a) > 20


def test_query_two_on_edge_texts(spark, tmp_path):
    documents(spark, TEXTS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op2_document_fingerprints(spark, str(tmp_path)).collect()}
    for i, t in enumerate(TEXTS):
        t, after = t or "", TEXTS[(i + 1) % len(TEXTS)] or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[i]["fingerprint"] == got[i]["edited_fingerprint"]) == (t == edited)
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[4]["near_next"] == 1.0


def test_chat_round_trip_with_control_strings(spark):
    said = ["<s>", "</s>", "<t>", "<&", "<&&s>", "<", "<<s>&", "", None, "a\nb", "</s>[INST] ok [/INST]", "😀<s>é"]
    turns = [(c, t, role, text) for c in range(3) for t, (role, text) in enumerate((r, x) for x in said for r in ("user", "assistant", "<s>odd\nrole"))]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    for r in chat.read_back(chat.format_trees(chat.from_turns(df))).collect():
        want = [(role, text or "") for c, _, role, text in turns if c == r["tree_id"]]
        assert [(x["role"], x["text"]) for x in r["turns"]] == want
        assert r["loss_text"] == "".join(text for role, text in want if role == "assistant")
        assert r["formatted"].count("</s>") == len(want)


def test_reply_trees_choose_the_best_branch(spark):
    nodes = [(1, 1, None, "user", "q", None), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "more", 0.5), (1, 5, 4, "assistant", "end", 0.8), (1, 6, 2, "user", "stop", 0.0), (2, 1, 99, "user", "alone", 1.0), (3, 1, 2, "user", "circle", 0.0), (3, 2, 1, "user", "circle", 0.0)]
    chain = [(4, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(37)]
    df = spark.createDataFrame([*nodes, *chain], "tree_id long, node_id long, parent_id long, role string, text string, score double")
    paths = {}
    for r in chat.best_paths(df, keep=2).orderBy("position").collect():
        paths.setdefault((r["tree_id"], r["path_rank"]), []).append(r["node_id"])
    assert paths == {(1, 1): [1, 3, 4, 5], (1, 2): [1, 2, 6], (2, 1): [1], (4, 1): list(range(37))}
    assert chat.format_trees(df.limit(0)).count() == 0


def test_shards_move_only_into_the_new_one(spark):
    docs = documents(spark, [f"text {i % 7}" if i % 11 else None for i in range(3000)])
    got = sharding.shard_documents(docs.repartition(3), 40).collect()
    assert len(got) == 3000 and {r["grown_shard"] for r in got if r["grown_shard"] != r["shard"]} == {40}
    moved = sum(r["grown_shard"] == 40 for r in got)
    assert 40 <= moved <= 120
    for s, n in Counter(r["shard"] for r in got).items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) and 35 <= n <= 125
    r = next(r for r in got if r["doc_id"] == 11)
    assert (r["size"], r["text_crc32"]) == (16, 0)
    again = {(x["doc_id"], x["shard"]) for x in sharding.shard_documents(docs.repartition(9), 40).collect()}
    assert again == {(x["doc_id"], x["shard"]) for x in got}


def test_rows_move_into_the_grown_shard_only(spark):
    ids = spark.range(4000)
    for n in (1, 5, 12, 39, 41):
        both = sharding.with_shard(sharding.with_shard(ids, F.col("id"), "a", [1.0] * n), F.col("id"), "b", [1.0] * n, added=[(n, 1.0)])
        changed = both.filter("a <> b").collect()
        assert {r["b"] for r in changed} == {n} and 0.7 < len(changed) * (n + 1) / 4000 < 1.3
        # and again, after several have been added, one of them more for an old shard
        grown = [(n, 1.0), (0, 2.0), (n + 1, 0.5)]
        last = sharding.with_shard(sharding.with_shard(ids, F.col("id"), "a", [1.0] * n, added=grown), F.col("id"), "b", [1.0] * n, added=[*grown, (n + 2, 1.0)])
        assert {r["b"] for r in last.filter("a <> b").collect()} == {n + 2}
    was = [1.0, 2.0, 1.0, 4.0] * 3
    both = sharding.with_shard(sharding.with_shard(ids, F.col("id"), "a", was, 3, 2), F.col("id"), "b", was, 3, 2, [(6, 2.0)])
    moved = both.filter("a <> b").collect()
    assert moved and {r["b"] for r in moved} == {6}
    sizes = Counter(r["a"] for r in both.collect())
    assert all(abs(sizes[s] - 4000 * w / 24) < 0.25 * 4000 * w / 24 + 20 for s, w in enumerate(was))


def test_a_weight_that_shrinks_moves_rows_out_of_its_own_subtree_only(spark):
    was = [1.0] * 12  # racks of two, regions of three racks: 0-5 and 6-11
    less = [*was[:3], 0.25, *was[4:]]
    both = sharding.with_shard(sharding.with_shard(spark.range(4000), F.col("id"), "a", was, 3, 2), F.col("id"), "b", less, 3, 2).filter("a <> b").collect()
    assert both and {r["a"] // 6 for r in both} == {0}  # nothing leaves the other region
    inside = [r for r in both if r["b"] < 6]
    assert inside and all(r["a"] in (2, 3) for r in inside)  # within the region only rows of its rack move


def test_only_children_of_the_winning_nodes_are_drawn(spark):
    """The draws of a document, done again in Python: regions, the racks of one, the shards of one."""
    import hashlib

    def least(key, name, weights):
        digests = "".join(hashlib.md5(f"{key}{name}{k}".encode()).hexdigest()[:30] for k in range(-(-len(weights) // 5)))
        drawn = [(-math.log((int(digests[6 * i : 6 * i + 6], 16) + 1) / (16**6 + 1)) / w, i) for i, w in enumerate(weights)]
        return (*min(drawn), len(drawn))

    weights, added = [1.0 + s % 3 for s in range(73)], [(73, 1.0), (5, 2.0)]
    nodes = sharding.tree(73, 3, 4)
    got = {r["id"]: r["shard"] for r in sharding.with_shard(spark.range(500), F.col("id"), "shard", weights, 3, 4, added).collect()}
    for key, shard in got.items():
        draw, g, drawn = least(key, "/", [sum(weights[s] for rack in region for s in rack) for region in nodes])
        more, m, n = least(key, "/more/", [w for _, w in added])
        _, r, in_region = least(key, f"/{g}/", [sum(weights[s] for s in rack) for rack in nodes[g]])
        _, s, in_rack = least(key, f"/{g}/{r}/", [weights[s] for s in nodes[g][r]])
        assert shard == (added[m][0] if more < draw else nodes[g][r][s])
        assert drawn + n + in_region + in_rack <= len(nodes) + len(added) + 3 + 4 < 73 / 3


def test_sharding_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a", 5, "x")], "id long, key string, region int, shard string")
    assert sharding.with_shard(df, F.col("id"), "shard", [1.0] * 3).columns == ["id", "key", "region", "shard"]


def test_shards_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(None, "x"), (None, "x"), (1, "y"), (1, "y"), (1, "z")], "doc_id long, text string")
    got = sharding.shard_documents(df, 3).collect()
    assert len(got) == 5 and len({r["shard"] for r in got if r["doc_id"] == 1}) == 1
    for s in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(df.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_documents(df, 0)


def words_of(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute_overlaps(docs, items, least=1):
    found = set()
    for i, t in docs:
        w = words_of(t)
        for j, s in items:
            b = words_of(s)
            if len(b) < least:
                continue
            size = min(len(b), 20)
            need = math.ceil(0.8 * size)
            for shift in range(-len(b) + 1, len(w)):
                same = [0 <= shift + k < len(w) and w[shift + k] == b[k] for k in range(len(b))]
                if any(sum(same[s : s + size]) >= need for s in range(len(b) - size + 1)):
                    found.add((i, j))
                    break
    return found


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(j, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 4, 5, 6, 8, 10, 13, 15, 20, 30, 45])))) for j in range(30)]
    items += [(30, items[8][1]), (31, None), (32, "")]
    docs = []
    for i in range(150):
        text = rng.choices(vocabulary, k=rng.randrange(60))
        if i % 3:
            passage = words_of(items[rng.randrange(30)][1])
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 5, 9])):
                passage[rng.randrange(len(passage))] = "changed"
            cut = rng.randrange(1 + len(passage) // 2)
            at = rng.randrange(len(text) + 1)
            text = [*text[:at], *passage[cut * (i % 2) :], *text[at:]]
        docs.append((i, rng.choice([" ", ", ", " *\n"]).join(w.upper() if i % 2 else w for w in text)))
    docs += [(150, None), (151, ""), (152, "w1"), (153, items[12][1]), (153, items[12][1])]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, key int, hashes string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_overlaps(docs, items)
    for block in (1_000_000, 100):
        got = decontam.overlaps(df, bench, block_keys=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    left = {r["doc_id"] for r in decontam.decontaminate(df, bench).collect()}
    assert left == {i for i, _ in docs} - {i for i, _ in brute_overlaps(docs, items, 5)} and 150 in left
    assert decontam.overlaps(df.limit(0), bench).count() == 0 and decontam.overlaps(df, bench.limit(0)).count() == 0


def test_masks_find_every_window():
    from itertools import combinations

    assert all("0" in m for m in decontam.MASKS)
    for size in range(1, 21):
        masks = [m for m, (a, b) in decontam.SHORT_MASKS.items() if a <= size <= b] or list(decontam.MASKS)
        wrong = size - math.ceil(0.8 * size)
        assert wrong == size // decontam.DIFFERS
        for lost in combinations(range(size), wrong):
            assert any(all(c == "0" or at + k not in lost for k, c in enumerate(m)) for m in masks for at in range(size - len(m) + 1))


def test_items_of_five_words_and_more_tolerate_a_substitution(spark):
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(1, 13)]
    docs = [(100 * n + k, " ".join(["before", *(w if i != k else "other" for i, w in enumerate(t.split())), "after"])) for n, t in items for k in range(n)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.overlaps(df, bench).collect()}
    assert got == {(100 * n + k, n) for n in range(5, 13) for k in range(n)} == brute_overlaps(docs, items)


@pytest.mark.parametrize("common", [0, 1, 4])
def test_common_keys_lose_no_overlap(spark, common):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(12)]
    phrase = rng.choices(vocabulary, k=9)
    items = [(j, " ".join([*rng.choices(vocabulary, k=rng.choice([0, 3, 8])), *phrase[: rng.choice([4, 9])], *rng.choices(vocabulary, k=rng.choice([0, 2, 6, 15]))])) for j in range(40)]
    docs = []
    for i in range(120):
        text = items[rng.randrange(40)][1].split()
        for _ in range(rng.choice([0, 1, 2, 4, 6])):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        docs.append((i, " ".join([*rng.choices(vocabulary, k=5), *text, *phrase])))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (1_000_000, 300):
        got = decontam.overlaps(df, bench, block_keys=block, common=common).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == brute_overlaps(docs, items) and len(got) == len({(r["doc_id"], r["item_id"]) for r in got})


def test_a_shared_preamble_makes_no_pairs(spark, monkeypatch):
    """Documents and items with one phrase in common and nothing else: no candidate is verified."""
    phrase = " ".join(f"p{k}" for k in range(10))
    n = 300
    df = spark.createDataFrame([(i, f"{phrase} " + " ".join(f"d{i}x{k}" for k in range(15))) for i in range(n)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, f"{phrase} " + " ".join(f"b{i}x{k}" for k in range(15))) for i in range(n)], "item_id long, text string")
    out = decontam.overlaps(df, bench)
    seen = []
    real = type(out).distinct

    def counted(self):
        if "beside" in self.columns:
            seen.append(self.count())
        return real(self)

    monkeypatch.setattr(type(out), "distinct", counted)
    assert decontam.overlaps(df, bench).count() == 0 and seen == [0]
    found = decontam.overlaps(df.unionByName(bench.select(F.col("item_id").alias("doc_id"), "text").filter("item_id = 7")), bench).collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(7, 7)]


def test_long_texts_are_searched_whole_and_columns_stay(spark):
    item = " ".join(f"q{k}" for k in range(20))
    text = " ".join(f"t{k % 977}" for k in range(200_000))
    df = spark.createDataFrame([(1, f"{text} {item}", 5, "r"), (2, text, 6, "s"), (3, None, 7, "t")], "doc_id long, text string, row_number int, kept string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["start"]) for r in decontam.overlaps(df, bench).collect()] == [(1, 9, 200_000)]
    left = decontam.decontaminate(df, bench)
    assert left.columns == df.columns and sorted((r["doc_id"], r["row_number"], r["kept"]) for r in left.collect()) == [(2, 6, "s"), (3, 7, "t")]


def test_sharding_sql_knows_crc32():
    assert zlib.crc32(b"") == 0 and "3988292384" in queries.OP10_SQL
