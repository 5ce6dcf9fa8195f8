import random

import numpy as np
from pyspark.sql import functions as F

from motifloom.llm.quality import FEATURES, bradley_terry, features, learn_ranker, score_quality
from tests.llm.conftest import words


def corpus(n=400):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        t = words(rng, rng.randint(5, 80), 300)
        if not good:
            t = rng.choice([t.upper().replace(" ", "!! "), t.replace(" ", "### "), " ".join(["x"] * 50)])
        rows.append((i, t))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark, make_docs):
    rows, labels = corpus()
    docs = make_docs(rows)
    table = spark.createDataFrame([*labels, (None, 1, 0), (9999, 0, 0), (1, 5, 0)], "doc_id long, quality int, toxic int")
    ranker = learn_ranker(docs, table, F.col("doc_id") % 5 != 0)
    got = {r["doc_id"]: r for r in score_quality(docs.withColumn("quality_pred", F.lit(9)), ranker).collect()}
    held = [(got[i]["quality_score"], got[i]["quality_pred"], q) for i, q, _ in labels if i % 5 == 0]
    assert np.mean([p == q for _, p, q in held]) > 0.95
    assert all(p == int(s >= 0.3) and 0 <= s <= 1 for s, p, _ in held)


def test_odd_texts(spark, make_docs, texts):
    rows, labels = corpus(80)
    ranker = learn_ranker(make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.lit(True))
    out = score_quality(make_docs(texts, extra=True), ranker).collect()
    assert len(out) == len(texts) and all(0 <= r["quality_score"] <= 1 for r in out)
    same = [r["quality_score"] for r in out if not r["text"]]
    assert len(set(same)) == 1
    assert score_quality(make_docs([]), ranker).count() == 0


def test_one_label_only(spark, make_docs):
    rows, _ = corpus(10)
    for labels in ([], [(1, 1, 0)]):
        ranker = learn_ranker(make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.lit(True))
        assert {r["quality_pred"] for r in score_quality(make_docs(rows), ranker).collect()} == {1}


def test_pairs_order_the_classes():
    rng = np.random.default_rng(1)
    y = (rng.random(300) < 0.7).astype(int)
    x = rng.normal(size=(300, len(FEATURES)))
    x[:, 3] += 3 * y
    r = bradley_terry(x, y)
    s = r.scores(x)
    assert s[y == 1].mean() > s[y == 0].mean() + 0.4
    assert len(features(b"a b")) == len(FEATURES) == len(features(None))


def test_weights_are_those_of_plain_descent():
    """Bradley-Terry by gradient steps on all pairs that were drawn, without Newton's method."""
    rng = np.random.default_rng(4)
    y = (rng.random(120) < 0.6).astype(int)
    x = rng.normal(size=(120, len(FEATURES)))
    x[:, 2] += y
    r = bradley_terry(x, y, pairs=500, penalty=0.05)
    z = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -8, 8)
    draw = np.random.default_rng(5)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    diff = z[draw.choice(good, 500)] - z[draw.choice(bad, 500)]
    w = np.zeros(len(FEATURES))
    for _ in range(6000):
        p = 1 / (1 + np.exp(diff @ w))
        w += 0.1 * ((diff * p[:, None]).mean(axis=0) - 0.05 * w)
    assert np.abs(w - r.weight).max() < 1e-3
    raw = z @ w
    cuts = sorted(raw)
    fewest = min(sum((raw[i] >= c) != y[i] for i in range(120)) for c in [*cuts, cuts[-1] + 1])
    assert sum((r.scores(x) >= r.cut) != y) <= fewest + 1


def test_extreme_texts_are_scored_as_the_border():
    rng = np.random.default_rng(4)
    y = (rng.random(200) < 0.5).astype(int)
    x = rng.normal(size=(200, len(FEATURES)))
    x[:, 1] += 2 * y
    r = bradley_terry(x, y)
    far, farther = r.mean + 9 * r.scale, r.mean + 9000 * r.scale
    assert r.scores(far[None])[0] == r.scores(farther[None])[0]
