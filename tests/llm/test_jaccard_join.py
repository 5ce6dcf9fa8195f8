import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motifloom.llm import jaccard_join as module
from motifloom.llm.components import connected_components
from motifloom.llm.jaccard_join import jaccard_components, jaccard_link_counts, may_link, ordered_prefix
from tests.llm.conftest import words


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in groups.items()}
    return sorted((i is None, i or 0, len(s), least[find(n)] or -1) for n, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def result(docs):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"] or -1) for r in jaccard_components(docs).collect())


def test_odd_texts(make_docs, texts):
    assert result(make_docs(texts, extra=True)) == brute(texts)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_chains_and_common_passages(make_docs, seed, monkeypatch):
    """Groups of near copies of every closeness, chains of small edits, and a passage that many share."""
    monkeypatch.setattr(module, "FLUSH_ROWS", 500)
    rng = random.Random(seed)
    common, rows = words(rng, 40, 900), []
    for _ in range(12):
        base = words(rng, rng.randint(6, 90), 900).split()
        for _ in range(rng.randint(1, 12)):
            if rng.random() < 0.3:
                base = list(base)
            copy = base if rng.random() < 0.5 else list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(900)}"
            rows.append((len(rows) + 1, " ".join(copy)))
        rows.append((len(rows) + 1, words(rng, 8, 900) + " " + common))
    assert result(make_docs(rows).repartition(4)) == brute(rows)


def test_empty_table(make_docs):
    assert jaccard_components(make_docs([])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(0, 30), st.integers(0, 30), st.integers(0, 10**6))
def test_linked_sets_share_enough_of_their_prefixes(common, more_a, more_b, seed):
    """Of two sets that link, at least l shared shingles are in both prefixes and pass may_link."""
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 1 << 58, common + more_a + more_b, dtype=np.uint64))
    rng.shuffle(pool)
    a, b = pool[: common + more_a], np.concatenate((pool[:common], pool[common + more_a :]))
    if len(a) * len(b) == 0 or 100 * common < 80 * (len(a) + len(b) - common):
        return
    level = rng.integers(0, 6, 1 << module.SLOT_BITS).astype(np.uint8)
    (pa, la), (pb, lb) = (ordered_prefix(np.sort(x), level, 80, 100, 2.0) for x in (a, b))
    place = {int(t): i for i, t in enumerate(pb)}
    hits = [(i, place[int(t)]) for i, t in enumerate(pa) if int(t) in place]
    passing = [h for h in hits if may_link(np.int64(len(a)), np.int64(h[0]), np.int64(la), np.int64(len(b)), np.int64(h[1]), np.int64(lb), 80, 100)]
    assert len(passing) >= min(la, lb)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (3, 1), (5, 5), (10, 11), (11, 12), (12, 13), (13, 14), (14, -4)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, **{i: -4 for i in (10, 11, 12, 13, 14, -4)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_around_frequent_nodes(spark, monkeypatch):
    """Two stars, one around its largest and one around a middle node, a bridge between leaves, and a chain."""
    edges = [(500, i) for i in range(100, 140)] + [(250, i) for i in range(230, 270)] + [(139, 231)] + [(i, i + 1) for i in range(600, 612)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(4)
    expected = {**{i: 100 for i in [500, 250, *range(100, 140), *range(230, 270)]}, **{i: 600 for i in range(600, 613)}}
    for limit in (1000, 5, 0):
        monkeypatch.setattr("motifloom.llm.components.HOT_ROWS", limit)
        assert dict(connected_components(frame).collect()) == expected


def test_only_frequent_nodes_and_texts_are_broadcast(spark, make_docs, monkeypatch):
    """A broadcast a step, though of nothing, filled the driver's memory over many rounds."""
    asked, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: asked.append(1) or broadcast(df))
    rng = random.Random(11)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)]
    rows = [(i, words(rng, 30)) for i in range(20)]
    rows += [(50 + i, rows[i % 4][1] + " tail" * (i % 2)) for i in range(12)]
    connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert result(make_docs(rows)) == brute(rows) and not asked
    monkeypatch.setattr("motifloom.llm.components.HOT_ROWS", 1)
    connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert asked


def test_link_counts(make_docs, texts):
    rng = random.Random(8)
    base = words(rng, 60).split()
    rows = list(texts)
    for i in range(40):
        # near copies in one component, of which only some pairs link
        own = list(base)
        for p in rng.sample(range(60), rng.randrange(3)):
            own[p] = f"x{i}"
        rows.append((200 + i, " ".join(own)))
    sets = [shingles(t) for _, t in rows]
    link = lambda a, b: 100 * len(a & b) >= 80 * len(a | b) and bool(a & b)
    expected = sorted((i is None, i or 0, len(a), sum(link(a, b) for m, b in enumerate(sets) if m != n)) for n, ((i, _), a) in enumerate(zip(rows, sets, strict=True)))
    got = jaccard_link_counts(make_docs(rows, extra=True)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["n_links"]) for r in got) == expected
    assert len({n for _, i, _, n in expected if i >= 200}) > 3
    assert jaccard_link_counts(make_docs([])).count() == 0


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rng = random.Random(12)
    base = [[f"w{rng.randrange(300)}" for _ in range(80)] for _ in range(12)]
    rows = [(i, " ".join(w if rng.random() > 0.01 else "x" for w in base[i % 12])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = sorted(map(tuple, jaccard_components(docs).collect()))
    monkeypatch.setattr(module, "_places", lambda cls: cls.view(np.uint64).astype(np.int64) & 7)
    assert sorted(map(tuple, jaccard_components(docs).collect())) == expected


def test_one_id_with_several_texts(spark):
    """Ids that repeat don't tie their texts together, and negative and null ids keep their order."""
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (1, b), (-5, a + " tail"), (None, b + " tail"), (None, "alone here"), (7, b)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_components(docs).collect()), key=str)
    assert got == sorted([(1, -5), (1, 1), (-5, -5), (None, 1), (None, None), (7, 1)], key=str)


def test_a_text_of_most_rows_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(module, "HOT_ROWS", 5)
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(100 + i, text) for i in range(30)] + [(7, text + " tail"), (8, "other words in here now"), (9, None), (None, text)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {**{100 + i: 7 for i in range(30)}, 7: 7, 8: 8, 9: 9, None: 7}
