import hashlib
import random

import public_tokenizers
import regex
import tiktoken
from pyspark.sql import functions as F

from motifloom.llm import byte_bpe as module
from motifloom.llm.byte_bpe import Cutter, encode_documents, fold_merges, heap_merges, rank_literal, read_ranks

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = read_ranks(PATH)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_documents(make_docs, texts, monkeypatch):
    monkeypatch.setattr(module, "CACHED_UNITS", 50)
    monkeypatch.setattr(module, "FILE_PIECES", 300)
    monkeypatch.setattr(module, "TASK_PIECES", 200)
    got = encode_documents(make_docs(texts, extra=True), PATH, public_tokenizers.PATTERN).collect()
    expected = []
    for i, t in texts:
        ids = REFERENCE.encode_ordinary(t or "")
        expected.append((i is None, i or 0, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["ids"]) for r in got) == sorted(expected)


def test_fold_equals_heap_equals_library(spark):
    rng = random.Random(2)
    pieces = ["".join(rng.choice("abcdet é日") for _ in range(rng.randint(1, 14))).encode() for _ in range(200)]
    df = spark.createDataFrame([(p.decode("latin-1"),) for p in pieces], "piece string")
    got = {r["piece"]: r["ids"] for r in df.select("piece", fold_merges(F.col("piece"), rank_literal(spark, RANKS)).alias("ids")).collect()}
    for p in pieces:
        assert got[p.decode("latin-1")] == heap_merges(p, RANKS)
    word = "".join(rng.choice("etaoin") for _ in range(3000))
    assert heap_merges(word.encode(), RANKS) == REFERENCE.encode_ordinary(word)


def test_units_do_not_change_the_pieces():
    c, rng = Cutter(public_tokenizers.PATTERN), random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice("ab 's 1!\n\té    don't ") for _ in range(rng.randint(0, 12)))
        if (u := c.units(t)) is not None:
            assert [*c.pieces(u[0]), *(p for x in u[1:] for p in c.pieces(" " + x))] == regex.findall(public_tokenizers.PATTERN, t)


def test_empty_table(make_docs):
    assert encode_documents(make_docs([]), PATH, public_tokenizers.PATTERN).count() == 0
