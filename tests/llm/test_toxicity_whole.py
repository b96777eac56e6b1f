"""The toxicity model learns from all rows; only the classifier's fit is bounded."""

import random
import zlib

import numpy as np

from footfall.llm import toxicity


def corpus(spark):
    rng = random.Random(0)
    docs, labels = [], []
    for i in range(900):
        text = [f"w{rng.randrange(300)}" for _ in range(40)]
        if i % 6 == 0:
            text[3] = "rotten" if i % 60 else "vile"
        docs.append((i, " ".join(text)))
        labels.append((i, int(i % 6 == 0)))
    docs += [(i, "w1 w2 rotten") for i in range(900, 1000)]
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_rows_beyond_the_bound_still_teach(spark, monkeypatch):
    docs, labels = corpus(spark)
    df = spark.createDataFrame(docs * 2, "doc_id long, text string")  # every id in two rows
    fitted, seen, fit, weigh = [], [], toxicity.linear_classifier, toxicity.label_weights
    monkeypatch.setattr(toxicity, "linear_classifier", lambda x, *a, **b: fitted.append(len(x)) or fit(x, *a, **b))
    monkeypatch.setattr(toxicity, "label_weights", lambda voted, *a, **b: seen.append(voted.count()) or weigh(voted, *a, **b))
    got = {r["doc_id"]: r["toxicity_score"] for r in toxicity.toxicity(df, labels, max_labelled=40).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert fitted == [40]
    assert seen == [2 * sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _ in docs)]
    clean = np.quantile([got[i] for i in held if i % 6], 0.95)
    assert all(got[i] > 2 * clean for i in held if i % 60 == 0)  # "vile" stands in a dozen labelled documents, hardly any of them among the 40
    assert sum((got[i] >= 0.5) == (i % 6 == 0) for i in held) >= 0.95 * len(held)


def test_sums_over_a_table_give_the_label_model(spark):
    rng = np.random.default_rng(0)
    gold = (rng.random(600) < 0.3).astype(float)
    votes = np.stack([np.where(rng.random(600) < 0.8, gold, 1 - gold) for _ in range(5)], 1)
    rows = [([int(k) for k in np.flatnonzero(v)], float(g)) for v, g in zip(votes, gold, strict=True)]
    weights = toxicity.label_weights(spark.createDataFrame(rows, "fired array<int>, toxic double").repartition(3), 5)
    assert np.allclose(toxicity._posterior(votes.astype(np.float32), gold, weights, toxicity.TRUST), toxicity.label_model(votes, gold), atol=1e-3)
