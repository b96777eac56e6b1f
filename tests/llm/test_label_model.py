"""The label model's posteriors on a tiny case, done again with plain loops and residuals instead of sums."""

import math
import random

import numpy as np
import pytest

from footfall.llm import toxicity


def clip(x, low, high):
    return max(low, min(high, x))


def brute_posteriors(votes, gold, rounds, trust=0.95):
    n_voters = len(votes[0])

    def by(weights, rows, golds):
        if weights is None:
            return [None if g is None else clip(g, 1 - trust, trust) for g in golds]
        prior, fires, silent = weights
        out = []
        for v, g in zip(rows, golds, strict=True):
            odds = math.log(prior / (1 - prior)) + sum(fires[j] if v[j] else silent[j] for j in range(n_voters))
            if g is not None:
                odds += (2 * g - 1) * math.log(trust / (1 - trust))
            out.append(1 / (1 + math.exp(-clip(odds, -30, 30))))
        return out

    def learn(rows, p):
        n = len(rows)
        on = [(sum(p[d] for d in range(n) if rows[d][j]) + 0.1) / (sum(p) + 0.2) for j in range(n_voters)]
        off = [(sum(1 - p[d] for d in range(n) if rows[d][j]) + 0.1) / (n - sum(p) + 0.2) for j in range(n_voters)]
        left = [[rows[d][j] - p[d] * on[j] - (1 - p[d]) * off[j] for d in range(n)] for j in range(n_voters)]
        size = [math.sqrt(sum(r * r for r in own)) + 1e-6 * math.sqrt(n) for own in left]
        share = []
        for j in range(n_voters):
            alike = sum((sum(a * b for a, b in zip(left[j], left[k], strict=True)) / (size[j] * size[k])) ** 2 for k in range(n_voters) if k != j)
            share.append(1 / (1 + alike))
        fires = [share[j] * math.log(on[j] / off[j]) for j in range(n_voters)]
        silent = [share[j] * math.log((1 - on[j]) / (1 - off[j])) for j in range(n_voters)]
        return clip(sum(p) / n, 1e-3, 1 - 1e-3), fires, silent

    known = [d for d, g in enumerate(gold) if g is not None]
    before, last = None, learn([votes[d] for d in known], by(None, [votes[d] for d in known], [gold[d] for d in known]))
    for _ in range(rounds - 1):
        p, was = by(last, votes, gold), by(before, votes, gold)
        if max(abs(a - b) for a, b in zip(p, was, strict=True) if b is not None) < 1e-4:
            break
        before, last = last, learn(votes, p)
    return by(last, votes, gold)


@pytest.mark.parametrize("rounds", [1, 2, 20])
def test_posteriors_equal_brute_force(spark, rounds):
    rng = random.Random(rounds)
    truth = [rng.random() < 0.4 for _ in range(60)]
    votes = [[int(rng.random() < (0.8 if t else 0.2)), int(rng.random() < (0.6 if t else 0.3)), 0, int(rng.random() < 0.5)] for t in truth]
    for v in votes:
        v[2] = v[0] if rng.random() < 0.9 else 1 - v[0]  # says again what the first one says
    gold = [float(t) if i < 12 else 0.5 if i == 12 else None for i, t in enumerate(truth)]
    rows = [(i, [j for j, fired in enumerate(v) if fired], g) for i, (v, g) in enumerate(zip(votes, gold, strict=True))]
    df = spark.createDataFrame(rows, "doc_id long, fired array<int>, toxic double").repartition(3)
    weights = toxicity.label_weights(df, 4, rounds)
    got = toxicity._posterior(np.array(votes, np.float32), np.array([np.nan if g is None else g for g in gold]), weights, 0.95)
    assert np.allclose(got, brute_posteriors(votes, gold, rounds), atol=2e-3)
