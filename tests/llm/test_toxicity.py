import math
import random

import numpy as np
import pyarrow as pa

from tracecheck.llm import toxicity


def made(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefg") for _ in range(r.randint(3, 8))) for _ in range(3000)]
    r = random.Random(seed + 1)
    texts, labels = [], []
    for k in range(n):
        w = [r.choice(words) for _ in range(r.randint(20, 120))]
        kind = k % 5
        if kind == 0:
            w += ["nastyword", "vileterm"][: r.randint(1, 2)]
        if kind == 1:
            w += [f"schlimm{r.choice(words)}" for _ in range(3)]
        r.shuffle(w)
        texts.append(" ".join(w))
        labels.append((kind == 0, kind == 1, kind < 2))
    return pa.array(texts, pa.large_string()), np.array(labels, np.int64)


def test_held_out_accuracy():
    texts, labels = made(1000, 3)
    chain = toxicity.train(texts.slice(0, 700), labels[:700])
    p = chain.predict(texts.slice(700))
    for k in range(3):
        assert ((p[:, k] >= 0.5) == labels[700:, k]).mean() > 0.95
    assert len(chain.models[2].chain) == 2 and len(chain.models[0].chain) == 0  # later models get earlier probabilities


def brute_logistic(a, y, at):
    """The same descent, one weight at a time."""
    w, g2, rate = [0.0] * a.shape[1], [1e-6] * a.shape[1], y.mean()
    bias = math.log((rate + 1e-4) / (1 - rate + 1e-4))
    for _ in range(toxicity.STEPS):
        r = [(1 / (1 + math.exp(-(sum(x * v for x, v in zip(row, w, strict=True)) + bias))) - t) / len(y) for row, t in zip(a, y, strict=True)]
        for k in range(len(w)):
            g = sum(e * row[k] for e, row in zip(r, a, strict=True)) + toxicity.RIDGE * w[k] / len(y)
            g2[k] += g * g
            w[k] -= toxicity.RATE * g / math.sqrt(g2[k])
        bias -= toxicity.RATE * sum(r)
    return [1 / (1 + math.exp(-(sum(x * v for x, v in zip(row, w, strict=True)) + bias))) for row in at]


def test_chain_equals_brute_force():
    """Each category's out-of-fold predictions feed the later models; scoring feeds them the chain's own."""
    r = random.Random(2)
    texts, labels = [], []
    for k in range(90):
        one, two = k % 3 == 0, k % 5 == 0
        own = [w for w, has in (("badword", one), ("viler", two), ("plain", not one)) if has and r.random() < 0.95] + ["filler"] * r.randint(1, 3)
        texts.append(" ".join(own))
        labels.append((one, two, one or two))
    y = np.array(labels, float)
    arr = pa.array(texts, pa.large_string())
    chain = toxicity.train(arr, y.astype(np.int64))
    count = lambda t, f: sum(f in toxicity.forms(w.encode()) for w in t.split())
    every = sorted({f for t in texts for w in t.split() for f in toxicity.forms(w.encode())})

    def chosen(col, rows):
        n1, n0 = max(1.0, sum(y[i, col] for i in rows)), max(1.0, sum(1 - y[i, col] for i in rows))
        out = []
        for f in every:
            hot, cold = (sum(count(texts[i], f) > 0 and y[i, col] == v for i in rows) for v in (1, 0))
            p = (hot + cold) / (n1 + n0)
            if hot + cold >= toxicity.MIN_DOCS and abs(hot / n1 - cold / n0) / math.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-9) >= toxicity.MIN_SCORE:
                out.append(f)
        return out

    def table(fs, extra, rows):
        return np.array([[*(math.log1p(count(texts[i], f)) for f in fs), *(e[i] for e in extra)] for i in rows], float).reshape(len(rows), len(fs) + len(extra))

    folds, scored, whole = [], [], range(len(texts))
    for col in range(3):
        out = [0.0] * len(texts)
        for f in range(toxicity.FOLDS):
            own, held = [i for i in whole if i % toxicity.FOLDS != f], [i for i in whole if i % toxicity.FOLDS == f]
            fs = chosen(col, own)
            for i, p in zip(held, brute_logistic(table(fs, folds, own), y[own, col], table(fs, folds, held)), strict=True):
                out[i] = p
        fs = chosen(col, list(whole))
        scored.append(brute_logistic(table(fs, folds, whole), y[:, col], table(fs, scored, whole)))
        folds.append(out)
    assert np.abs(chain.predict(arr) - np.array(scored).T).max() < 0.02


def test_tables(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    chain = toxicity.train(*toxicity.sample(docs, labels))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity.score(docs, chain, keep=["doc_id"]).collect() if r.doc_id in truth]
    assert np.mean([r.toxic == bool(truth[r.doc_id]) for r in rows]) > 0.95
    assert toxicity.score(odd, chain, keep=["doc_id"]).count() == odd.count()
    assert toxicity.score(none, chain, keep=["doc_id"]).count() == 0
    empty = toxicity.train(*toxicity.sample(none, labels))
    assert {r.toxic for r in toxicity.score(odd, empty, keep=["doc_id"]).collect()} == {False}
