"""What the toxicity operator counts and looks up with arrays, against plain loops over words."""

import time
from collections import Counter

import numpy as np
import pyarrow as pa

from footfall.llm import toxicity

ODD = ["", "  ", "Ünïcödé ΣΑΣ ΟΔΟΣ. İstanbul İ x y", "a\x1cb c\u0085d", "ABCD abcd. (abcdefgh) abcdefghi 'x'", "…abc… «naïve»　naïve NAÏVE!", "!!! ???", "= ^ 2 2=a", "ßßß ẞẞẞ ǅabc"]


def patterns(word: str) -> list[str]:
    bare = word.lower().strip(toxicity.STRIP)
    return ["=" + bare, *("^" + bare[:n] for n in toxicity.STARTS if n <= len(bare))] if bare else []


def shown(words: list[str]) -> list[str]:
    times = Counter(p for w in words for p in patterns(w))
    return [*times, *(toxicity.TWICE + p for p, n in times.items() if n > 1)]


def test_patterns_are_counted_as_by_a_loop():
    for texts in (ODD, ODD[:1], ODD[4:7], ["Abc abc. abd", "abc", "ABC!"] * 3):
        toxic = np.arange(len(texts)) % 2 / 2
        want: dict[str, list[float]] = {}
        for text, t in zip(texts, toxic):
            for p in (toxicity.EVERY, *shown(text.split())):
                held = want.setdefault(p, [0, 0.0])
                held[0] += 1
                held[1] += t
        rows = [r for batch in toxicity.pattern_counts(pa.array(texts, pa.string()), toxic) for r in batch.to_pylist()]
        assert len(rows) == len({r["pattern"] for r in rows})
        assert {r["pattern"]: [r["n"], r["t"]] for r in rows} == want


def test_voters_fire_as_by_a_loop():
    names = ["=abcd", "2=abcd", "^abc", "2^abc", "=naïve", "2=naïve", "^οδο", "=σας", "2^nev"]
    index = {v: i for i, v in enumerate(names)}
    row, voter = toxicity._fired(pa.array(ODD, pa.string()), index)
    want = {(i, index[p]) for i, text in enumerate(ODD) for p in shown(text.replace("　", "x").replace("\x1c", "x").replace("\u0085", "x").split()) if p in index}
    assert set(zip(row.tolist(), voter.tolist())) == want and len(row) == len(want) and (np.diff(row) >= 0).all()


def test_counting_new_words_takes_no_python_loop():
    rng = np.random.default_rng(0)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    texts = pa.array([" ".join("".join(w) for w in letters[rng.integers(0, 26, (300, 9))]) for _ in range(400)])
    began = time.process_time()
    for text in texts.to_pylist():
        shown(text.split())
    loop, began = time.process_time() - began, time.process_time()
    sum(b.num_rows for b in toxicity.pattern_counts(texts, np.zeros(400)))
    assert time.process_time() - began < loop / 2
