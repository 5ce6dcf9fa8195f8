import hashlib
import math
import random
from collections import Counter

import numpy as np
import xxhash

from motifloom.llm.simhash import BITS, edited, fingerprint_documents, fingerprints, likeness, near_fingerprints
from tests.llm.conftest import words


def test_documents(make_docs, texts):
    rng = random.Random(1)
    rows = texts + [(100 + i, words(rng, rng.randint(0, 80))) for i in range(60)]
    got = fingerprint_documents(make_docs(rows, extra=True).repartition(7)).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    order = [r for r in rows if r[0] is not None and r[0] >= 100]
    for (i, t), (_, following) in zip(order[:-1], order[1:], strict=True):
        changed = edited(t, following)
        r, (a, b, c) = by_id[i], fingerprints([x.encode() for x in (t, changed, following)])
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (a.tobytes().hex(), b.tobytes().hex())
        assert (r["near_edited"], r["near_next"]) == (likeness(a[None], b[None])[0], likeness(a[None], c[None])[0])
    assert by_id[6]["fingerprint"] == by_id[5]["fingerprint"]


def test_last_is_followed_by_the_first(make_docs):
    got = {r["doc_id"]: r for r in fingerprint_documents(make_docs([(1, "abcd"), (2, "efgh")])).collect()}
    assert got[2]["edited_sha256"] == hashlib.sha256(b"efab").hexdigest()
    alone = fingerprint_documents(make_docs([(1, "abcd")])).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and alone["near_next"] == 1
    assert fingerprint_documents(make_docs([])).count() == 0


def test_search_finds_all_near_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, (12, BITS // 8), dtype=np.uint8)
    prints = [x.tobytes().hex() for x in base]
    for x in base:
        for flips in (1, 4, 6, 7, 9):
            bits = np.unpackbits(x)
            bits[rng.choice(BITS, flips, replace=False)] ^= 1
            prints.append(np.packbits(bits).tobytes().hex())
    rows = [(p,) for p in [*prints, prints[0], None]]
    got = {(r["a"], r["b"], r["distance"]) for r in near_fingerprints(spark.createDataFrame(rows, "fingerprint string"), radius=6).collect()}
    number = lambda p: int(p, 16)
    expected = {(a, b, (number(a) ^ number(b)).bit_count()) for a in set(prints) for b in set(prints) if a < b and (number(a) ^ number(b)).bit_count() <= 6}
    assert got == expected and len(got) >= 36


def plain_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % 2**64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % 2**64
    return x ^ (x >> 31)


def plain_simhash(text):
    """The votes counted one by one, with whole numbers of Python; words hash as polynomials of their bytes."""
    base = 0x9E3779B97F4A7C15 | 1
    word = lambda w: plain_mix(sum((b + 1) * pow(base, i + 1, 2**64) for i, b in enumerate(w)) * pow(base, -1, 2**64) % 2**64)
    h = [word(w) for w in text.split()]
    if len(h) > 1:
        terms = Counter(plain_mix((a + plain_mix(b) * 3) % 2**64) for a, b in zip(h, h[1:], strict=False))
    else:
        terms = Counter(h or [xxhash.xxh3_64_intdigest(text)])
    votes = [0] * BITS
    for t, n in terms.items():
        weight = int(16 * (1 + math.log2(n)))
        data = t.to_bytes(8, "little") + plain_mix(t ^ 0x5851F42D4C957F2D).to_bytes(8, "little")
        for i in range(BITS):
            votes[i] += weight if data[i // 8] >> (7 - i % 8) & 1 else -weight
    return sum(1 << (BITS - 1 - i) for i, v in enumerate(votes) if v > 0).to_bytes(BITS // 8, "big").hex()


def test_bits_are_the_signs_of_plain_votes(texts):
    rng = random.Random(7)
    some = [(t or "").encode() for _, t in texts if len(t or "") < 2000] + [words(rng, n).encode() for n in range(25)]
    got = [x.tobytes().hex() for x in fingerprints(some)]
    assert got == [plain_simhash(t) for t in some]


def test_near_copies_of_texts_are_found_by_their_prints(make_docs):
    """Texts with one word changed, at a radius that reaches them; members of equal prints by a join."""
    rng = random.Random(8)
    rows = []
    for g in range(8):
        base = words(rng, 400, 5000).split()
        for i in range(4):
            w = list(base)
            if i > 1:
                w[rng.randrange(400)] = "changed"
            rows.append((10 * g + i, " ".join(w)))
    prints = fingerprint_documents(make_docs(rows)).select("doc_id", "fingerprint")
    number = {r["doc_id"]: int(r["fingerprint"], 16) for r in prints.collect()}
    radius = 7
    expected = {(a, b) for a in number for b in number if a < b and (number[a] ^ number[b]).bit_count() <= radius}
    near = near_fingerprints(prints, radius=radius, blocks=8)
    a, b = prints.toDF("x", "a"), prints.toDF("y", "b")
    across = [tuple(sorted((r["x"], r["y"]))) for r in near.join(a, "a").join(b, "b").collect()]
    equal = [(r["x"], r["y"]) for r in a.join(b, a["a"] == b["b"]).filter("x < y").collect()]
    assert sorted(across + equal) == sorted(expected)
    assert {(10 * g, 10 * g + 1) for g in range(8)} <= set(equal) and len(across) >= 8
