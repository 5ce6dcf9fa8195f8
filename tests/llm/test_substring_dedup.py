import random

import numpy as np
import pytest

from motifloom.llm import substring_dedup as module
from motifloom.llm.substring_dedup import heavy_slots, later_windows, substring_dedup
from tests.llm.conftest import words


def brute(rows, k):
    """Kept words by (id, text): windows are judged on the input, rows equal in both are one."""
    seen, out = {}, {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        w = (text or "").encode().split()
        gone = set()
        for s in range(len(w) - k + 1):
            key = tuple(w[s : s + k])
            if key in seen:
                gone.update(range(s, s + k))
            seen.setdefault(key, (doc_id, s))
        out[doc_id, text] = (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    return out


def test_odd_texts(make_docs, texts):
    docs = make_docs(texts, extra=True)
    got = substring_dedup(docs, window=20)
    assert set(got.columns) == {"doc_id", "score", "sequence_id", "kept_text", "n_words", "n_removed"}
    rows = got.collect()
    assert len(rows) == len(texts)
    expected = sorted((i is None, i or 0, *x) for (i, t) in texts for x in [brute(texts, 20)[i, t]])
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept_text"]) for r in rows) == expected


@pytest.mark.parametrize("heavy", [1 / 2048, 0.0])
def test_random_passages(make_docs, heavy, monkeypatch):
    """Many shared passages, in blocks of few texts, and with every slot heavy or none."""
    monkeypatch.setattr(module, "BLOCK_BYTES", 3000)
    rng = random.Random(8)
    shared = [words(rng, 45) for _ in range(4)] + [words(rng, 22, 3)]
    rows = [(i, " ".join(x for _ in range(rng.randint(1, 4)) for x in (words(rng, rng.randint(0, 30)), rng.choice(shared)))) for i in range(120)]
    docs = make_docs(rows).repartition(5)
    real = module.heavy_slots
    monkeypatch.setattr(module, "heavy_slots", lambda t, c, s: real(t, c, s) if heavy else np.ones(1 << module.SLOT_BITS, bool))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup(docs, window=10).collect()}
    assert got == {i: x for (i, _), x in brute(rows, 10).items()}


def test_equal_hashes_are_settled_on_the_words():
    h = np.array([5, 5, 5, 5], dtype=np.uint64)
    texts = [b"a", b"b", b"a", b"b"]
    assert later_windows(h, (np.array([1, 2, 3, 4]),), lambda i: texts[i]).tolist() == [False, False, True, True]


def test_empty_table(make_docs):
    assert substring_dedup(make_docs([])).count() == 0
    assert not heavy_slots(make_docs([]).selectExpr("text"), 3, 0.1).any()
