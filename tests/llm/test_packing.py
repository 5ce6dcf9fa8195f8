import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from motifloom.llm import packing as module
from motifloom.llm.packing import best_fit_decreasing, best_fit_pack, lower_bound, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_layout(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_documents(make_docs, texts):
    rows = pack_documents(make_docs(texts, extra=True), PATH, capacity=2048).collect()
    check_layout(rows, 2048)
    plain = Tokenizer.from_file(PATH)
    expected = []
    for i, t in texts:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        expected += [(i is None, i or 0, p, 2048 * p, len(ids[2048 * p : 2048 * p + 2048]), zlib.crc32(ids[2048 * p : 2048 * p + 2048].tobytes())) for p in range(-(-len(ids) // 2048))]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(expected)


def test_words_with_the_mark():
    encoder, plain = module.WordEncoder(PATH), Tokenizer.from_file(PATH)
    words = [b"a", b"\x01", b"x\x01", b"\x01y", b"caf\xc3\xa9!!", *(f"w{i}###".encode() for i in range(250))]
    assert encoder._words(words) == [np.array(plain.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes() for w in words]


def test_added_tokens_are_what_the_library_makes_of_them():
    encoder, plain = module.WordEncoder(PATH), Tokenizer.from_file(PATH)
    texts = ["<|endoftext|> x", "a<|startoftext|>b <|endoftext|>", "<|ENDOFTEXT|> y", "x <|endoftext |>", "no token", "a\n<|endoftext|>\n\tb  c", ""]
    assert encoder.encode([t.encode() for t in texts]) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_exchange_reaches_the_bound(spark, monkeypatch):
    """Many partitions, each with a gap: after the exchange few sequences over the bound are left."""
    monkeypatch.setattr(module, "PARTITION_PIECES", 40)
    rng = random.Random(2)
    lengths = [rng.randint(1, 60) for _ in range(700)]
    pieces = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long").repartition(6)
    rows = best_fit_pack(pieces, capacity=100).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(700))
    assert module.certified_bound(pieces, 100) == lower_bound(np.array(lengths), 100)
    assert check_layout(rows, 100) <= lower_bound(np.array(lengths), 100) + 3


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for _ in range(30):
        x = rng.integers(1, 101, rng.integers(1, 12))
        bins, offsets = best_fit_decreasing(x, 100)
        assert lower_bound(x, 100) <= bins.max() + 1
        assert np.bincount(bins, weights=x).max() <= 100
    assert lower_bound(np.array([51, 51, 51]), 100) == 3 and lower_bound(np.array([], dtype=int), 100) == 0


def test_empty_table(make_docs):
    assert pack_documents(make_docs([]), PATH).count() == 0
