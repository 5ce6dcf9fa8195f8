import numpy as np
from pyspark.sql import functions as F

from motifloom.llm.ann import nearest

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, 2.0) for i, v in rows], SCHEMA)


def exact(rows, queries, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float32).astype(float)
    out = {}
    for i, v in rows:
        if queries(i):
            s = (x * np.array(v, dtype=np.float32).astype(float)).sum(axis=1)
            s[ids == i] = -np.inf
            out[i] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s))[:k] if s[j] > -np.inf]
    return out


def test_recall(spark):
    rng = np.random.default_rng(2)
    rows = list(enumerate(rng.normal(size=(5000, 24)).tolist()))
    got = nearest(frame(spark, rows), F.col("vec_id") % 50 == 0).collect()
    true = exact(rows, lambda i: i % 50 == 0, 20)
    assert all(sum(r["query_id"] == q for r in got) == 20 for q in true)
    assert np.mean([(r["vec_id"] in dict(true[r["query_id"]])) for r in got]) >= 0.9
    x = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows}
    assert all(abs(r["score"] - (x[r["query_id"]] * x[r["vec_id"]]).sum()) < 1e-12 for r in got)


def test_odd_vectors_ties_and_few_candidates(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(12, 5)).tolist())] + [(40 + i, [1, 1, 1, 1, 1]) for i in range(9)]
    odd = [(100, None), (101, []), (102, [0] * 5), (103, [1, None, 1, 1, 1]), (104, [float("nan")] * 5), (105, [float("inf"), 1, 1, 1, 1]), (None, [1] * 5), (106, [1, 2])]
    got = nearest(frame(spark, rows + odd), F.lit(True), k=6)
    true = exact(rows, lambda i: True, 6)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert found == {q: [i for i, _ in x] for q, x in true.items()}
    assert nearest(frame(spark, rows[:3]), F.lit(True), k=6).count() == 6


def test_nothing_usable(spark):
    assert nearest(frame(spark, [(1, None), (2, [0, 0])]), F.lit(True)).count() == 0
    assert nearest(frame(spark, []), F.lit(True)).count() == 0
    assert nearest(frame(spark, [(1, [1, 2])]), F.lit(True)).count() == 0


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4500, 24))
    x[1000:] = x[1000] + 1e-3 * rng.normal(size=(3500, 24))
    rows = list(enumerate(x.tolist()))
    got = nearest(frame(spark, rows), F.col("vec_id") % 50 == 0, probes=2).collect()
    true = exact(rows, lambda i: i % 50 == 0, 20)
    assert [(r["query_id"], r["vec_id"]) for r in sorted(got, key=lambda r: (r["query_id"], r["rank"]))] == [(q, i) for q, found in sorted(true.items()) for i, _ in found]


def test_small_lists_fill_all_ranks(spark):
    rng = np.random.default_rng(6)
    # outliers with a list each, met first by queries near them
    x = np.concatenate((rng.normal(size=(9000, 8)), 1000 * np.eye(8)[:3]))
    rows = [*enumerate(x.tolist()), *((9001, v) for v in x[:30].tolist())]
    got = nearest(frame(spark, rows), (F.col("vec_id") % 100 == 0) | (F.col("vec_id") == 9002), probes=1).collect()
    ranks = {}
    for r in got:
        ranks.setdefault(r["query_id"], []).append(r["rank"])
        assert r["vec_id"] != r["query_id"]
    assert set(ranks) == {*range(0, 9001, 100), 9000, 9002}
    assert all(sorted(v) == list(range(1, 21)) for v in ranks.values())
