import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifloom.llm import kneser_ney as module
from motifloom.llm.kneser_ney import discounts, score_documents, train
from tests.llm.conftest import words

END = b"\0end"


def brute(train_texts, order):
    """(chance of a token after those before it, base chance, known words, tokens) of a plain model."""
    raw = defaultdict(Counter)
    for t in train_texts:
        w = [END, *(t or "").encode().lower().split(), END]
        for m in range(1, order + 1):
            raw[m].update(tuple(w[i - m + 1 : i + 1]) for i in range(max(1, m - 1), len(w)))
    counts = {order: raw[order]}
    for m in range(1, order):
        before = Counter(g[1:] for g in raw[m + 1])
        counts[m] = Counter({g: before[g] if m == 1 or g[0] != END else raw[m][g] for g in raw[m]})
    cut = {m: discounts([sum(1 for y in c.values() if y == k) for k in (1, 2, 3, 4)]) for m, c in counts.items()}
    total, left = Counter(), defaultdict(float)
    for m, c in counts.items():
        for g, x in c.items():
            total[m, g[:-1]] += x
            left[m, g[:-1]] += cut[m][min(x, 3)]
    v, n = len(raw[1]), sum(raw[1].values())

    def chance(g):
        m, context = len(g), g[:-1]
        lower = chance(g[1:]) if m > 1 else 1 / (v + 1)
        if not total[m, context]:
            return lower
        x = counts[m][g]
        return (max(x - cut[m][min(x, 3)], 0) + left[m, context] * lower) / total[m, context]

    return chance, lambda b: (raw[1][b,] + 1) / (n + v + 1), {g[0] for g in raw[1]}, n


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores(make_docs, texts, monkeypatch, order):
    monkeypatch.setattr(module, "FLUSH_TOKENS", 400)
    monkeypatch.setattr(module, "FILE_TOKENS", 100)
    rng = random.Random(3)
    rows = texts + [(100 + i, words(rng, rng.randint(0, 90))) for i in range(80)] + [(200 + i, "w1 w2 w3 w4 w1 w2") for i in range(400)]
    docs = make_docs(rows, extra=True).repartition(6)
    model = train(docs.filter("doc_id >= 100 and doc_id % 5 <> 0"), order)
    chance, base, known, n = brute([t for i, t in rows if i is not None and i >= 100 and i % 5], order)
    got = score_documents(docs.withColumn("place", F.xxhash64("text")), model).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, t in rows:
        if i is None:
            continue
        w = [END, *(t or "").encode().lower().split(), END]
        r = by_id[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w) - 1, sum(b in known for b in w[1:]), n)
        assert r["base_score"] == pytest.approx(sum(math.log10(base(b)) for b in w[1:]))
        assert r["score"] == pytest.approx(sum(math.log10(chance(tuple(w[max(0, i - order + 1) : i + 1]))) for i in range(1, len(w))))
    before = (b"w4", b"w2", b"w1")[3 - order + 1 :] if order > 1 else ()
    assert sum(chance((*before, b)) for b in known) + chance((*before, b"never seen")) == pytest.approx(1)


def test_nothing_to_learn_from(make_docs):
    model = train(make_docs([]))
    r = score_documents(make_docs([(1, "a b"), (2, None)]), model).orderBy("doc_id").collect()
    assert (r[0]["n_tokens"], r[0]["n_known"], r[0]["train_tokens"], r[0]["base_score"]) == (3, 0, 0, 0)
    assert r[1]["n_tokens"] == 1 and score_documents(make_docs([]), model).count() == 0


def test_files_without_longer_ngrams(make_docs):
    model = train(make_docs([(1, "a"), (2, None), (3, "b")]), 4)
    r = score_documents(make_docs([(1, "a"), (2, "b a b a c"), (3, "")]), model).orderBy("doc_id").collect()
    chance, *_ = brute(["a", None, "b"], 4)
    for x, t in zip(r, ("a", "b a b a c", ""), strict=True):
        w = [END, *t.encode().split(), END]
        assert x["score"] == pytest.approx(sum(math.log10(chance(tuple(w[max(0, i - 3) : i + 1]))) for i in range(1, len(w))))
    with pytest.raises(ValueError):
        train(make_docs([]), 0)


def test_discounts():
    assert discounts([0, 0, 0, 0]).tolist() == [0, 0.5, 1, 1.5]
    d = discounts([100, 40, 20, 10])
    y = 100 / 180
    assert d[1:] == pytest.approx([1 - 2 * y * 0.4, 2 - 3 * y * 0.5, 3 - 4 * y * 0.5])


def test_counts_over_32_bits_stay_whole():
    key = np.array([3, 5, 2**63], np.uint64)
    count = np.array([1, 2**32 + 7, 2**40], np.int64)
    for part in (module._expand(module._squeeze(key, count)), module._summed([key, key], [count - 1, np.ones(3, np.int64)])):
        assert part[0].tolist() == key.tolist() and part[1].tolist() == count.tolist()
    packed = module._bytes(np.concatenate((count, [254, 255])))
    assert module._wide(packed)[:, 0].tolist() == [*count.tolist(), 254, 255]
    assert module._wide(packed, np.array([4, 1, 0]))[:, 0].tolist() == [255, 2**32 + 7, 1]
    rows = np.array([[1, 300], [255, 2], [2**40, 0]])
    assert module._wide(module._bytes(rows), np.array([2, 0]), 2).tolist() == rows[[2, 0]].tolist()
    assert module._narrow(count).tolist() == count.tolist() and module._narrow(count[:1]).dtype == np.uint32
    (batch,) = module._dealt("context", np.array([0, 10]), np.array([2, 4]), np.array([[2**33, 1], [3, 2**34]]))
    ids, values = module._load(batch.column("data")[0].as_py())
    assert ids.tolist() == [2, 4] and values.tolist() == [2**33, 1, 3, 2**34]


def test_lookups_do_without_sorts_and_passes_over_all():
    """The time of training and scoring: ascending files are slices, a search halves whole stretches
    in few steps, pairs are sorted with their places, and blocks hold no empty planes."""
    rng = np.random.default_rng(5)
    assert [(k, x) for k, x in module._by_file(np.array([2, 2, 5]))] == [(2, slice(0, 2)), (5, slice(2, 3))]
    assert [(k, x.tolist()) for k, x in module._by_file(np.array([5, 2, 5]))] == [(2, [1]), (5, [0, 2])]
    assert not list(module._by_file(np.zeros(0, np.int64)))

    sizes = np.array([0, 1, 2, 3, 0, 7, 64, 1000, 1])
    stretches = [np.sort(rng.choice(5000, n, replace=False)).astype(np.uint32) for n in sizes]
    ends = np.cumsum(sizes)
    file = np.concatenate(stretches)
    which = np.repeat(np.arange(len(sizes)), 5000)
    want = np.tile(np.arange(5000), len(sizes)).astype(np.uint64)
    mix = rng.permutation(len(want))
    place, ok = module._find(file, (ends - sizes)[which[mix]], ends[which[mix]], want[mix])
    assert ok.tolist() == [w in held for w, held in zip(want[mix].tolist(), [set(stretches[k].tolist()) for k in which[mix]], strict=True)]
    assert (file[place[ok]] == want[mix][ok]).all() and (place[ok] >= (ends - sizes)[which[mix]][ok]).all() and (place[ok] < ends[which[mix]][ok]).all()

    a, b = rng.integers(0, 50, 900), rng.integers(0, 40, 900)
    for contexts, words in ((50, 40), (2**32, 2**32), (2**40, 2**24), (1 << 27, 1 << 27)):  # packed with places and not
        context, word, sample, place = module._distinct(a, b, contexts, words)
        assert list(zip(context, word, strict=True)) == sorted(set(zip(a, b, strict=True)))
        assert (a[sample] == context).all() and (b[sample] == word).all() and (context[place] == a).all() and (word[place] == b).all()
    assert [len(x) for x in module._distinct(a[:0], b[:0], 1, 1)] == [0, 0, 0, 0]

    bucket, key, count = rng.integers(0, 9, 500), rng.integers(0, 30, 500).astype(np.uint64), rng.integers(1, 5, 500)
    got = module._summed_by_bucket([bucket[:200].astype(np.int32), bucket[200:].astype(np.int32)], [key[:200], key[200:]], [count[:200], count[200:]])
    want = Counter()
    for k, x, n in zip(bucket.tolist(), key.tolist(), count.tolist(), strict=True):
        want[k, x] += n
    assert list(zip(got[0].tolist(), got[1].tolist(), got[2].tolist(), strict=True)) == [(*k, n) for k, n in sorted(want.items())]

    assert module._planes(np.array([0, 255])) == b"\1\0\xff" and module._planes(np.zeros(3, np.uint64)) == b"\0"
    for keys, counts in (([], []), ([0], [0]), ([1, 2**64 - 1], [255, 256])):
        blob = module._squeeze(np.array(keys, np.uint64), np.array(counts, np.int64))
        assert [x.tolist() for x in module._expand(blob)] == [keys, counts]
