"""Best-fit packing of tokenised documents with certified bin counts.

Documents become pieces of at most ``capacity`` tokens.  Partitions of bounded size pack their
pieces by best-fit decreasing and bound their own optimum from below with dual-feasible
functions.  That certifies it, up to the free space of its last sequences.  Partitions exchange their
least filled sequences, more of them where there is a gap to the bound: those of several
partitions are pooled, packed again by best-fit decreasing, and the better of both packings stays.  Packing only moves
(row, length) records; the text is read once, for tokenising.
"""

from __future__ import annotations

import logging
import os
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifloom.llm._shared import stored
from motifloom.llm._text import binary, held, slices

PARTITION_PIECES = 60_000
FAN_IN = 16
CACHED_WORDS = 750_000
MARK = b"\x01"
STALE = 2  # rounds of exchange without a gain after which it ends

_log = logging.getLogger(__name__)


class WordEncoder:
    """Token ids of whole texts, word by word.

    The tokenizer drops white space and never joins across it, so the ids of a text are those
    of its words one after another; frequent words are encoded once per worker.  A text with
    the string of an added token, which the library finds before it looks at words, is
    encoded as a whole.
    """

    def __init__(self, path: str):
        # one task, one core: the library's own threads only cost time here
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word: many words in one string, with a word between them that none contains."""
        out: dict[bytes, bytes] = {}
        plain = [w for w in words if MARK not in w]
        lines = [plain[i : i + 100] for i in range(0, len(plain), 100)]
        between = f" {MARK.decode()} "
        for line, e in zip(lines, self.tokenizer.encode_batch_fast([between.join([w.decode() for w in x]) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            data, cuts = ids.tobytes(), (4 * np.flatnonzero(ids == self.mark)).tolist()
            out.update((w, data[a:b]) for w, a, b in zip(line, [0, *(x + 4 for x in cuts)], [*cuts, len(data)], strict=True))
        odd = [w for w in words if MARK in w]
        for w, e in zip(odd, self.tokenizer.encode_batch_fast([w.decode() for w in odd], add_special_tokens=False), strict=True):
            out[w] = array("I", e.ids).tobytes()
        return [out[w] for w in words]

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        known = self.known
        whole = [i for i, t in enumerate(texts) if t and any(x in t for x in self.added)]
        own = dict(zip(whole, self.tokenizer.encode_batch_fast([texts[i].decode() for i in whole], add_special_tokens=False), strict=True))
        split = [t.split() if t and i not in own else [] for i, t in enumerate(texts)]
        found = [list(map(known.get, words)) for words in split]
        holes = [i for i, ids in enumerate(found) if None in ids]
        new = list({w for i in holes for w, x in zip(split[i], found[i], strict=True) if x is None})
        if new:
            fresh = dict(zip(new, self._words(new), strict=True))
            for i in holes:
                found[i] = [fresh[w] if x is None else x for w, x in zip(split[i], found[i], strict=True)]
            if len(known) + len(fresh) <= CACHED_WORDS:
                known.update(fresh)
        return [array("I", own[i].ids).tobytes() if i in own else b"".join(ids) for i, ids in enumerate(found)]


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; the fullest bin that has room takes it."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: dict[int, list[int]] = defaultdict(list)  # by free space
    mask, n = 0, 0  # bit r: some bin has r free
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        if fits := mask >> size:
            free = size + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                mask ^= 1 << free
        else:
            free, b = capacity, n
            n += 1
        bins[i], offsets[i] = b, capacity - free
        left = free - size
        if left:
            room[left].append(b)
            mask |= 1 << left
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the largest bound over two families of dual-feasible functions."""
    return lower_bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity) if len(lengths) else 0


def lower_bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """The same from the number of pieces of each length, 0 to ``capacity``."""
    count = count.astype(np.int64)
    size = np.arange(capacity + 1)
    below_n, below_s = np.cumsum(count), np.cumsum(count * size)
    k = np.arange(1, capacity // 2 + 1)
    # sizes over capacity - k count as full bins, sizes under k as nothing
    full = int(below_n[-1]) - below_n[capacity - k]
    middle = below_s[capacity - k] - below_s[k - 1]
    best = max(-(-int(below_s[-1]) // capacity), int(np.max(-(-(full * capacity + middle) // capacity), initial=0)))
    for q in range(1, 33):  # x -> floor((q + 1) x) / q, exact multiples unchanged
        scaled = (q + 1) * size
        whole = scaled % capacity == 0
        # in units of 1 / (q * capacity)
        value = np.where(whole, q * size, (scaled // capacity) * capacity)
        best = max(best, -(-int((count * value).sum()) // (q * capacity)))
    return best


def certified_bound(pieces: DataFrame, capacity: int = 2048) -> int:
    """No packing of all ``pieces`` has fewer sequences; one row per length comes to the driver."""
    count = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        count[r["length"]] = r["count"]
    return lower_bound_of_counts(count, capacity)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece of each document: (doc_id, piece, start, length, ids_crc32 [, ids]).

    A null text is an empty one: its only token is ``end_id``.  Rows keep a null id, and
    repeated rows are packed once each.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(("words", tokenizer_path), lambda: WordEncoder(tokenizer_path))
        for b in slices(batches, "text", holding=True):
            rows: list[tuple] = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), encoder.encode(binary(b.column("text"))), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), *((np.frombuffer(part, "<u4").astype(np.int64),) if with_ids else ())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * with_ids]
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return own.mapInArrow(cut, _PIECES + ", ids array<long>" * with_ids)


def _arranged(table: pa.Table, bins: np.ndarray, offsets: np.ndarray, tag: int) -> pa.Table:
    for name, x in (("sequence_id", (np.int64(tag) << np.int64(32)) + bins), ("offset", offsets)):
        table = table.set_column(table.schema.get_field_index(name), name, pa.array(x, pa.int64()))
    return table


def _gap_and_offer(table: pa.Table, capacity: int, tag: int) -> pa.Table:
    """Marks the rows to exchange: none of a packing without free space, else the least filled
    sequences (more of them, the further the packing is from its bound) and those of the most,
    so smallest, pieces, which fill others' gaps."""
    lengths = table["length"].to_numpy()
    _, bins = np.unique(table["sequence_id"].to_numpy(), return_inverse=True)
    n = bins.max() + 1
    gap = int(n) - lower_bound(lengths, capacity)
    offer = np.zeros(n, dtype=bool)
    fill = np.bincount(bins, weights=lengths)
    if (fill < capacity).any():
        offer[np.argsort(fill, kind="stable")[: 8 + 4 * gap]] = True
        offer[np.argsort(-np.bincount(bins), kind="stable")[:8]] = True
    table = table.set_column(table.schema.get_field_index("offered"), "offered", pa.array(offer[bins]))
    table = table.set_column(table.schema.get_field_index("gap"), "gap", pa.array(np.full(len(lengths), gap), pa.int64()))
    return table.set_column(table.schema.get_field_index("part"), "part", pa.array(np.full(len(lengths), tag), pa.int64()))


def best_fit_pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (with ``length`` of 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Offsets are gapless from 0 within a sequence.  No row is dropped; columns of those two
    names are replaced.  Empty input gives no rows.  Exchange goes on until the number of
    sequences meets the bound of all pieces (then no packing has fewer) or STALE rounds in a
    row save none; both numbers are logged.
    """
    spark = pieces.sparkSession
    pieces = stored(pieces.drop("sequence_id", "offset"), "pieces")
    names = pieces.columns
    parts = max(1, -(-pieces.count() // PARTITION_PIECES))
    extra = (("part", "long"), ("offered", "boolean"), ("gap", "long"), ("sequence_id", "long"), ("offset", "long"))
    start = pieces.select(*names, F.pmod(F.xxhash64(*names), F.lit(parts)).alias("part"), *(F.lit(None).cast(t).alias(c) for c, t in extra[1:]))
    schema = start.schema

    def first(key, table):
        tag = key[0].as_py()
        table = _arranged(table, *best_fit_decreasing(table["length"].to_numpy(), capacity), tag)
        return _gap_and_offer(table, capacity, tag)

    packed = stored(start.groupBy("part").applyInArrow(first, schema), "packed")
    bound, best, stale, r = certified_bound(pieces, capacity), None, 0, 0
    while True:
        now = packed.agg(F.countDistinct("sequence_id").alias("n"), F.countDistinct(F.when(F.col("offered"), F.col("part"))).alias("open")).first()
        stale = 0 if best is None or now["n"] < best else stale + 1
        best = now["n"]
        # one partition alone has nobody to exchange with
        if best == bound or now["open"] < 2 or stale == STALE:
            break
        moving = F.pmod(F.xxhash64("part", F.lit(r)), F.lit(-(-now["open"] // FAN_IN)))
        packed = _exchanged(packed, moving, r, capacity)
        r += 1
    _log.info("%d sequences after %d exchanges; no packing has fewer than %d", best, r, bound)
    return packed.select(*names, "sequence_id", "offset")


def _exchanged(packed: DataFrame, moving: Column, r: int, capacity: int) -> DataFrame:
    """The packing after the offered sequences met by ``moving`` and were packed again."""

    def again(key, table):
        tag = ((r + 1) << 24) + key[0].as_py()
        bins, offsets = best_fit_decreasing(table["length"].to_numpy(), capacity)
        if bins.max() + 1 < len(table["sequence_id"].unique()):
            table = _arranged(table, bins, offsets, tag)
        return _gap_and_offer(table, capacity, tag)

    moved = packed.filter("offered").withColumn("part", moving).groupBy("part").applyInArrow(again, packed.schema)
    return stored(packed.filter("not offered").unionByName(moved), "packed")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every document's pieces with their sequences; see token_pieces and best_fit_pack."""
    return best_fit_pack(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids), capacity)
