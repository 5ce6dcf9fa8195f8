"""SimHash fingerprints of whole texts, and the search for near ones.

Terms are pairs of neighbouring words (the word itself in a one-word text, the bytes of a text
without words).  A term's weight grows with the logarithm of its count; each of its hash bits
votes with that weight for or against the fingerprint's bit.

The search cuts fingerprints into blocks.  Two fingerprints within ``radius`` bits agree on at
least blocks - radius of them, so a table for each such choice of blocks, keyed by their bits,
holds every near pair in a common bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.llm._shared import shuffle_partitions, stored
from motifloom.llm._text import U64, mix, slices, words_of

BITS = 128
_CHUNK = 1 << 15


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """BITS / 8 bytes for each text; equal texts have equal fingerprints."""
    w = words_of(texts)
    h = w.hashes()
    pairs = mix(h[:-1] + mix(h[1:]) * U64(3)) if len(h) else h
    out = np.zeros((len(texts), BITS // 8), dtype=np.uint8)
    for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
        if b - a > 1:
            terms, count = np.unique(pairs[a : b - 1], return_counts=True)
        elif b - a == 1:
            terms, count = h[a:b], np.ones(1)
        else:
            terms, count = np.array([xxhash.xxh3_64_intdigest(texts[i])], dtype=U64), np.ones(1)
        # whole weights: their sums are exact in any order
        weight = np.floor(16 * (1 + np.log2(count)))
        votes = np.zeros(BITS)
        for at in range(0, len(terms), _CHUNK):
            t, v = terms[at : at + _CHUNK], weight[at : at + _CHUNK]
            bits = np.unpackbits(np.stack((t, mix(t ^ U64(0x5851F42D4C957F2D))), axis=1).view(np.uint8), axis=1)
            votes += 2 * (v @ bits) - v.sum()
        out[i] = np.packbits(votes > 0)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits of each pair of fingerprints."""
    return 1 - np.unpackbits(a ^ b, axis=1).sum(axis=1) / BITS


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as much of the start of ``following`` (or all of it)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_FIELDS = [
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("role", pa.string()), ("text", pa.string()),
]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, part int, role string, text string"


def _rows(ids: list, texts: list[str], prints: np.ndarray, following: list[str], next_prints: np.ndarray, part: int) -> pa.RecordBatch:
    changed = [edited(t, f).encode() for t, f in zip(texts, following, strict=True)]
    new = fingerprints(changed)
    k = len(ids)
    columns = [
        ids, [len(t) for t in texts], [hashlib.sha256(t).hexdigest() for t in changed], [p.tobytes().hex() for p in prints], [p.tobytes().hex() for p in new],
        likeness(prints, new), likeness(prints, next_prints), [part] * k, ["row"] * k, [None] * k,
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])


def _lone(doc_id, text: str, part: int, role: str) -> pa.RecordBatch:
    columns = [doc_id, None, None, None, None, None, None, part, role, text]
    return pa.RecordBatch.from_arrays([pa.array([c], t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition; its last text waits for the next partition's first."""
    held = None
    part = 0
    for b in slices(batches, "text"):
        ids, texts = b.column("doc_id").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
        part = b.column("part")[0].as_py()
        prints = fingerprints([t.encode() for t in texts])
        if held is None:
            yield _lone(ids[0], texts[0], part, "first")
        else:
            ids, texts, prints = [held[0], *ids], [held[1], *texts], np.concatenate((held[2][None], prints))
        if len(ids) > 1:
            yield _rows(ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:], part)
        held = ids[-1], texts[-1], prints[-1]
    if held is not None:
        yield _lone(held[0], held[1], part, "last")


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            texts, following = b.column("text").to_pylist(), b.column("following").to_pylist()
            yield _rows(b.column("doc_id").to_pylist(), texts, fingerprints([t.encode() for t in texts]), following, fingerprints([t.encode() for t in following]), 0)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Each text is compared with its edited form and with the next document by ascending id (the
    first, after the last).  A null text is an empty one.  Rows with a null id come last, rows
    of one id are ordered by a hash of their text; equal rows follow one another.  One
    document alone is its own next; empty input gives no rows.

    The rows are sorted once over the cluster by ranges of the id; across the borders of ranges
    only one text each is exchanged.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text").asc()]
    dealt = own.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    walked = stored(dealt.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(_walk, _SCHEMA), "fingerprints")
    parts = sorted(r["part"] for r in walked.filter("role = 'first'").select("part").collect())  # one number per partition
    pairs = spark.createDataFrame([(p, q) for p, q in zip(parts, parts[1:] + parts[:1], strict=True)], "part int, next int")
    first = walked.filter("role = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"))
    ends = walked.filter("role = 'last'").select("doc_id", "text", "part").join(pairs, "part").join(first, "next").select("doc_id", "text", "following")
    done = walked.filter("role = 'row'").unionByName(ends.mapInArrow(_finish, _SCHEMA))
    return done.drop("part", "role", "text")


def near_fingerprints(prints: DataFrame, radius: int = 6, blocks: int = 8, print_col: str = "fingerprint") -> DataFrame:
    """Pairs (a, b, distance) of distinct fingerprints, a < b, that differ in 1 to ``radius`` bits.

    Every such pair is found.  A pair that differs in r of 128 bits has an expected cosine of
    cos(pi r / 128) between its weighted terms: 6 bits stand for 0.989, so the default finds texts
    that are all but equal.  Sets of one size with a Jaccard of 0.8 have 0.89, about 19 bits, for
    which block tables are too wide to be of use; the Jaccard join finds those.  Equal fingerprints are one class and appear once; join
    ``prints`` on the fingerprint for its members.  Nulls are left out.
    """
    if not radius < blocks <= BITS:
        raise ValueError("blocks must be over radius")
    halves = prints.select(F.col(f"`{print_col}`").alias("p")).filter("p is not null").distinct()
    edge = [BITS * i // blocks for i in range(blocks + 1)]
    # the fingerprint as a string of bits, so that any block is a substring
    bits = F.concat(*(F.lpad(F.conv(F.substring("p", 1 + 8 * i, 8), 16, 2), 32, "0") for i in range(BITS // 32)))
    keys = [
        F.concat(F.lit(f"{n}:"), *(F.substring("bits", edge[i] + 1, edge[i + 1] - edge[i]) for i in chosen))
        for n, chosen in enumerate(combinations(range(blocks), blocks - radius))
    ]
    tables = halves.withColumn("bits", bits).select("p", F.explode(F.array(*keys)).alias("key"))
    word = lambda c, i: F.conv(F.substring(c, 1 + 8 * i, 8), 16, 10).cast("long")
    distance = sum((F.bit_count(word("a", i).bitwiseXOR(word("b", i))) for i in range(BITS // 32)), F.lit(0))
    met = tables.toDF("a", "key").join(tables.toDF("b", "key"), "key").filter("a < b")
    return met.select("a", "b", distance.cast("int").alias("distance")).filter(F.col("distance") <= radius).distinct()
