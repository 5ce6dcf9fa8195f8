"""Substring deduplication over super-k-mers.

A window is ``window`` consecutive words of one text.  Every word covered by a window whose
word sequence also starts earlier goes.  *Earlier* is a smaller (id, text hash, start); a null
id is the largest.

1. Map: word hashes give each window a minimiser, the smallest hash of ``core`` consecutive
   words in it.  Windows that already occurred earlier in the same task's block are settled
   there, so a passage shared by many texts leaves each task once.  Consecutive remaining
   windows with one minimiser travel as one packed string to the minimiser's bucket; strings
   for one bucket are compressed together.
2. Bucket: equal windows share a minimiser and so a bucket.  There the windows are sorted by
   hash, equal hashes are compared byte by byte, and all but the earliest are marked.
3. The marked ranges of a text meet its row again, and the words are cut.

Before that, one cheap scan counts minimiser candidates in a sketch of fixed size; slots that
hold a large share of all rows are ordered last, so that windows only use them when they hold
nothing else (then they lie inside one common passage, which step 1 has already merged).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.llm._shared import shuffle_partitions
from motifloom.llm._text import U64, Words, binary, mix, release, runs_hash, sliding_min, slices, words_of

BLOCK_BYTES = 4 << 20
SLOT_BITS = 16
_NULL = np.iinfo(np.int64).max

_PACKED = "bucket int, id long, th long, data binary"


class _Block:
    """Texts of one task, up to about BLOCK_BYTES, with their windows."""

    def __init__(self, words: Words, ids: np.ndarray, th: np.ndarray, window: int, core: int, heavy: np.ndarray):
        self.words, self.ids, self.th, self.k = words, ids, th, window
        h = words.hashes()
        n = max(0, len(h) - window + 1)
        counts = words.counts
        self.text_of_word = np.repeat(np.arange(len(counts)), counts)
        inside = self.text_of_word[:n] == self.text_of_word[window - 1 : window - 1 + n]
        self.at = np.flatnonzero(inside)  # first word of every window
        self.hash = runs_hash(h, window)[self.at]
        grams = order_key(runs_hash(h, core), heavy)
        self.minimiser = sliding_min(grams, window - core + 1)[self.at] if n else np.empty(0, U64)

    def bytes_of(self, word: int) -> bytes:
        return self.words.data[self.words.starts[word] : self.words.ends[word + self.k - 1]]


def order_key(grams: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Hash order of the candidates for minimiser, heavy slots last."""
    if not len(heavy):
        return grams >> U64(1)
    return (grams >> U64(1)) | (heavy[grams >> U64(64 - SLOT_BITS)].astype(U64) << U64(63))


def later_windows(h: np.ndarray, keys: tuple[np.ndarray, ...], text) -> np.ndarray:
    """Whether each window has an equal one with a smaller key.

    h: window hashes; keys: arrays to order by, the most significant first;
    text(i): the bytes of window i.  Equal hashes are settled on the bytes.
    """
    out = np.zeros(len(h), dtype=bool)
    if len(h) < 2:
        return out
    order = np.argsort(h, kind="stable")
    sorted_h = h[order]
    new = np.concatenate(([True], sorted_h[1:] != sorted_h[:-1]))
    size = np.diff(np.append(np.flatnonzero(new), len(h)))
    member = np.repeat(size > 1, size)
    if not member.any():
        return out
    some = order[member]
    group = np.cumsum(new)[member]
    some = some[np.lexsort((*(k[some] for k in reversed(keys)), group))]
    starts = np.concatenate(([True], group[1:] != group[:-1]))
    leader = np.repeat(some[starts], np.diff(np.append(np.flatnonzero(starts), len(some))))
    same_key = np.ones(len(some), dtype=bool)
    for k in keys:
        same_key &= k[some] == k[leader]
    out[some] = ~same_key
    odd = set()
    last, first_text = -1, b""
    for g, i, j in zip(group[~starts].tolist(), some[~starts].tolist(), leader[~starts].tolist(), strict=True):
        if j != last:
            last, first_text = j, text(j)
        if text(i) != first_text:
            odd.add(g)
    for g in odd:  # two sequences with one hash: by the bytes alone
        first: dict[bytes, tuple] = {}
        for i in some[group == g].tolist():
            key = tuple(k[i] for k in keys)
            out[i] = first.setdefault(text(i), key) != key
    return out


def _ranges(block_texts: np.ndarray, starts: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per text the marked windows (ascending by text and start) as merged word ranges."""
    if not len(starts):
        return
    cut = np.flatnonzero((block_texts[1:] != block_texts[:-1]) | (starts[1:] > starts[:-1] + k)) + 1
    a = np.concatenate(([0], cut))
    b = np.concatenate((cut, [len(starts)])) - 1
    spans = np.stack((starts[a], starts[b] + k), axis=1).astype("<i8")
    owner = block_texts[a]
    at = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    for x, y in zip(at, np.append(at[1:], len(owner)), strict=True):
        yield int(owner[x]), spans[x:y]


def _pack(block: _Block, buckets: int) -> list[tuple]:
    """Rows of _PACKED: settled ranges (bucket of any number) and packed strings."""
    w, k = block.words, block.k
    text = block.text_of_word[block.at]
    word0 = w.first[text]
    start = block.at - word0
    marked = later_windows(block.hash, (block.ids[text], block.th[text], start), lambda i: block.bytes_of(int(block.at[i])))
    rows = []
    m = np.flatnonzero(marked)
    for t, spans in _ranges(text[m], start[m], k):
        rows.append((hash((int(block.ids[t]), int(block.th[t]))) % buckets, None if block.ids[t] == _NULL else int(block.ids[t]), int(block.th[t]), spans.tobytes()))
    keep = np.flatnonzero(~marked)
    if not len(keep):
        return rows
    at, mini, text, start = block.at[keep], block.minimiser[keep], text[keep], start[keep]
    cut = np.flatnonzero((at[1:] != at[:-1] + 1) | (mini[1:] != mini[:-1]) | (text[1:] != text[:-1])) + 1
    a = np.concatenate(([0], cut))
    b = np.concatenate((cut, [len(at)])) - 1
    bucket = (mix(mini[a]) % U64(buckets)).astype(np.int64)
    lo, hi = w.starts[at[a]], w.ends[at[b] + k - 1]
    order = np.argsort(bucket, kind="stable")
    edges = np.append(np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0))), len(order))
    squeeze = zstandard.ZstdCompressor(level=6)
    for x, y in zip(edges[:-1], edges[1:], strict=True):
        s = order[x:y]
        head = np.stack((block.ids[text[a[s]]], block.th[text[a[s]]], start[a[s]]), axis=1).astype("<i8").tobytes()
        body = b"\n".join([w.data[p:q] for p, q in zip(lo[s].tolist(), hi[s].tolist(), strict=True)])
        rows.append((int(bucket[s[0]]), None, None, squeeze.compress(struct.pack("<q", len(s)) + head + body)))
    return rows


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("id", pa.int64()), ("th", pa.int64()), ("data", pa.binary())])
_RANGES_ARROW = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("data", pa.binary())])


def _blocks(batches: Iterator[pa.RecordBatch], window: int, core: int, heavy: np.ndarray) -> Iterator[_Block]:
    for b in slices(batches, "text", BLOCK_BYTES):
        ids = b.column("id").fill_null(_NULL).to_numpy(zero_copy_only=False)
        yield _Block(words_of(binary(b.column("text"))), ids, b.column("th").to_numpy(zero_copy_only=False), window, core, heavy)


def _sketch(core: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        for b in slices(batches, "text"):
            total += np.bincount((runs_hash(words_of(binary(b.column("text"))).hashes(), core) >> U64(64 - SLOT_BITS)).astype(np.int64), minlength=len(total))
        if total.any():
            yield pa.RecordBatch.from_pydict({"part": pa.array([0], pa.int32()), "data": pa.array([zstandard.compress(total.tobytes())], pa.binary())})

    return count


def _sum_sketches(key, table):
    total = np.zeros(1 << SLOT_BITS, dtype=np.int64)
    for x in table["data"].to_pylist():
        total += np.frombuffer(zstandard.decompress(x), dtype=np.int64)
    return pa.table({"part": pa.array([0], pa.int32()), "data": pa.array([zstandard.compress(total.tobytes())], pa.binary())})


def heavy_slots(texts: DataFrame, core: int, share: float) -> np.ndarray:
    """Slots of the sketch (2 ** SLOT_BITS flags) that hold over ``share`` of all rows."""
    parts = texts.select("text").mapInArrow(_sketch(core), "part int, data binary")
    # partial sums first, so that no task reads the sketches of all
    some = parts.withColumn("part", F.spark_partition_id() % 16).groupBy("part").applyInArrow(_sum_sketches, "part int, data binary")
    total = np.zeros(1 << SLOT_BITS, dtype=np.int64)
    for r in some.collect():  # at most 16 rows of a fixed size
        total += np.frombuffer(zstandard.decompress(bytes(r["data"])), dtype=np.int64)
    return total > max(1000, share * total.sum())


def duplicate_ranges(texts: DataFrame, window: int = 20, core: int = 2, heavy_share: float = 1 / 2048) -> DataFrame:
    """Marked word ranges of ``texts(id long, th long, text string)`` as rows (id, th, data),
    data holding pairs of little-endian 64-bit word positions (start, end)."""
    spark = texts.sparkSession
    core = min(core, window)
    buckets = 4 * shuffle_partitions(spark)
    heavy = heavy_slots(texts, core, heavy_share)
    flags = spark.sparkContext.broadcast(np.packbits(heavy).tobytes())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(flags.value, dtype=np.uint8))
        for block in _blocks(batches, window, core, bits):
            if rows := _pack(block, buckets):
                for at in range(0, len(rows), 500):
                    yield _batch(rows[at : at + 500], _PACKED_ARROW)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for b in batches:
            through = pc.is_valid(b.column("th"))
            if (own := b.filter(through)).num_rows:
                yield pa.RecordBatch.from_arrays([own.column(c) for c in _RANGES_ARROW.names], schema=_RANGES_ARROW)
            own = b.filter(pc.invert(through))
            for k, x in zip(own.column("bucket").to_pylist(), own.column("data").to_pylist(), strict=True):
                held.setdefault(k, []).append(x)
        for k in sorted(held):
            rows = _settle(held.pop(k), window)
            for at in range(0, len(rows), 10_000):
                yield _batch(rows[at : at + 10_000], _RANGES_ARROW)
        release()

    packed = texts.select("id", "th", "text").mapInArrow(pack, _PACKED)
    return packed.repartition("bucket").mapInArrow(settle, "id long, th long, data binary")


def _settle(blobs: list[bytes], k: int) -> list[tuple]:
    """The ranges of a bucket's windows that occurred earlier."""
    heads, bodies = [], []
    for x in blobs:
        raw = zstandard.decompress(x)
        (n,) = struct.unpack_from("<q", raw)
        heads.append(np.frombuffer(raw, dtype="<i8", count=3 * n, offset=8).reshape(n, 3))
        bodies.append(raw[8 + 24 * n :])
    head = np.concatenate(heads)
    strings = b"\n".join(bodies).split(b"\n")
    w = words_of(strings)
    n = np.diff(w.first) - k + 1  # windows of each string
    owner = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = w.first[owner] + offset
    h = runs_hash(w.hashes(), k)[at]
    ids, th, start = head[owner, 0], head[owner, 1], head[owner, 2] + offset
    data, lo, hi = w.data, w.starts, w.ends
    marked = np.flatnonzero(later_windows(h, (ids, th, start), lambda i: data[lo[at[i]] : hi[at[i] + k - 1]]))
    if not len(marked):
        return []
    m = marked[np.lexsort((start[marked], th[marked], ids[marked]))]
    new = np.concatenate(([True], (ids[m][1:] != ids[m][:-1]) | (th[m][1:] != th[m][:-1])))
    text, one = np.cumsum(new) - 1, m[new]
    return [(None if ids[one[t]] == _NULL else int(ids[one[t]]), int(th[one[t]]), spans.tobytes()) for t, spans in _ranges(text, start[m], k)]


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one for the way to their ranges."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for b in slices(batches, "__text", 1 << 23):
        small = [None if t is None else squeeze.compress(t) for t in binary(b.column("__text"))]
        at = b.schema.get_field_index("__text")
        yield b.set_column(at, pa.field("__text", pa.binary()), pa.array(small, pa.binary()))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept, n_words, n_removed = [], [], []
        for t, ranges in zip(b.column("__text").to_pylist(), b.column("__ranges").to_pylist(), strict=True):
            words = zstandard.decompress(t).split() if t else []
            gone = np.zeros(len(words) + 1, dtype=np.int64)
            for x in ranges or ():
                spans = np.frombuffer(x, dtype="<i8").reshape(-1, 2)
                np.add.at(gone, spans[:, 0], 1)
                np.add.at(gone, spans[:, 1], -1)
            n_words.append(len(words))
            if ranges:
                stay = np.cumsum(gone[:-1]) == 0
                n_removed.append(int(len(words) - stay.sum()))
                words = [words[i] for i in np.flatnonzero(stay).tolist()]
            else:
                n_removed.append(0)
            kept.append(b" ".join(words))
        names = [c for c in b.schema.names if c not in ("__text", "__ranges")]
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in names), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
            names=[*names, "kept_text", "n_words", "n_removed"],
        )


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, core: int = 2) -> DataFrame:
    """``docs`` with ``kept_text`` (kept words joined by one space), ``n_words`` and ``n_removed``.

    The text column itself is not among the result's columns, and columns of those three names
    in ``docs`` are replaced.  A null or empty text has no words
    and ``kept_text`` is empty.  Rows with a null id come last in the order; rows of one id are
    ordered by a hash of their text, and rows equal in both are the same document: they are
    judged alike, and none counts as an earlier place of the other.  Empty input gives no rows.
    """
    own = [c for c in docs.columns if c not in ("kept_text", "n_words", "n_removed")]
    keyed = docs.select(
        *(F.col(f"`{c}`") for c in own if c != text_col),
        F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").alias("__text"), F.xxhash64(F.col(f"`{text_col}`")).alias("__th"),
    )
    texts = keyed.select(F.col("__id").alias("id"), F.col("__th").alias("th"), F.col("__text").alias("text"))
    ranges = duplicate_ranges(texts, window, core).groupBy(F.col("id").alias("__rid"), F.col("th").alias("__rth")).agg(F.collect_list("data").alias("__ranges"))
    kinds = {f.name: f.dataType.simpleString() for f in keyed.schema.fields} | {"__text": "binary"}
    sent = keyed.mapInArrow(_small, ", ".join(f"`{c}` {kinds[c]}" for c in keyed.columns))
    met = sent.join(ranges, F.col("__id").eqNullSafe(F.col("__rid")) & (F.col("__th") == F.col("__rth")), "left").drop("__rid", "__rth", "__id", "__th")
    kinds = {f.name: f.dataType.simpleString() for f in met.schema.fields}
    out = [f"`{c}` {kinds[c]}" for c in met.columns if c not in ("__text", "__ranges")]
    return met.mapInArrow(_cut, ", ".join([*out, "kept_text string", "n_words long", "n_removed long"]))
