"""Byte-level BPE encoding and decoding with a rank file.

1. The texts are cut by the tokenizer's pattern; each distinct piece of the corpus is kept once.
2. Spark folds the ranked merges over the bytes of these pieces with higher-order functions:
   the state is the array of parts and the array of their pairs' ranks, every step merges
   the leftmost pair of the lowest rank, and ranks come from one literal map.  (A map is
   searched entry by entry, so the literal is an array of small maps, indexed by a hash.)
3. Pieces and ids become sorted hash arrays in files of the shared folder.  Workers map them into
   memory and look up each piece of each whole text; frequent pieces stay in a bounded cache.

Decoding concatenates the bytes of the ids.  Bytes are written as characters of the same number
(ISO-8859-1) where Spark handles them as strings.
"""

from __future__ import annotations

import base64
import hashlib
import json
import mmap
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom.llm._shared import local_copy, put_file, shared_dir, stored
from motifloom.llm._text import U64, held, slices, span_hashes

BUCKETS = 1 << 16
FOLD_BYTES = 48  # longer pieces are merged with a heap: the fold's time grows with the square
TASK_PIECES = 300_000
CACHED_UNITS = 1_000_000
FILE_PIECES = 500_000
_NONE = 2**31 - 1
ID = np.dtype("<u4")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def rank_literal(spark: SparkSession, ranks: dict[bytes, int]) -> tuple[Column, Column]:
    """The ranks as literals: an array of maps that the key's hash indexes, and, for pairs of
    single bytes, an array that 256 * first + second indexes."""
    keys = [(token.decode("latin-1"), rank) for token, rank in ranks.items()]
    maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    placed = spark.createDataFrame(keys, "key string, rank int").select("key", "rank", F.hash("key").bitwiseAND(BUCKETS - 1).alias("b"))
    for r in placed.collect():  # the tokenizer's fixed vocabulary
        maps[r["b"]][r["key"]] = r["rank"]
    pairs = [ranks.get(bytes((i >> 8, i & 255)), _NONE) for i in range(1 << 16)]
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>"), F.from_json(F.lit(json.dumps(pairs)), "array<int>")


def fold_merges(piece: Column, literals: tuple[Column, Column]) -> Column:
    """Ids of a piece (a string of byte characters) as array<int>; literals: rank_literal()."""

    def of(maps: Column, key: Column) -> Column:
        return F.coalesce(F.get(maps, F.hash(key).bitwiseAND(BUCKETS - 1))[key], F.lit(_NONE))

    def merged(maps: Column, state: Column) -> Column:
        p, r = state["p"], state["r"]

        def at(pos: Column) -> Column:
            new = F.concat(F.get(p, pos - 1), F.get(p, pos))
            # the pairs with the part before and the part after, null at the ends
            keys = F.array(F.concat(F.get(p, pos - 2), new), F.concat(new, F.get(p, pos + 1)))
            ranks = F.transform(F.filter(keys, lambda key: key.isNotNull()), lambda key: of(maps, key))
            return F.struct(
                F.concat(F.slice(p, F.lit(1), pos - 1), F.array(new), F.slice(p, pos + 2, F.lit(FOLD_BYTES))).alias("p"),
                F.concat(F.slice(r, F.lit(1), F.greatest(pos - 2, F.lit(0))), ranks, F.slice(r, pos + 2, F.lit(FOLD_BYTES))).alias("r"),
            )

        return F.transform(F.array(F.array_position(r, F.array_min(r)).cast("int")), at)[0]

    def pairs(codes: Column) -> Column:
        """Ranks of neighbouring single bytes."""
        n = F.size(codes) - 1
        return F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: F.get(literals[1], a * 256 + b))

    def fold(maps: Column) -> Column:
        start = lambda parts: F.transform(F.array(F.transform(parts, lambda x: F.ascii(x))), lambda codes: F.struct(parts.alias("p"), pairs(codes).alias("r")))[0]
        begun = F.transform(F.array(F.split(piece, "")), start)[0]
        ended = F.aggregate(
            F.sequence(F.lit(1), F.length(piece) - 1),
            begun,
            lambda state, _: F.when((F.size(state["r"]) == 0) | (F.array_min(state["r"]) == _NONE), state).otherwise(merged(maps, state)),
        )
        whole = of(maps, piece)
        return F.when(whole != _NONE, F.array(whole)).otherwise(F.transform(ended["p"], lambda x: of(maps, x)))

    return F.transform(F.array(literals[0]), fold)[0]


def heap_merges(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids in n log n steps, for long pieces."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here; 0 once it is merged away
    before = list(range(-1, n - 1))
    heap = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapify(heap)
    while heap:
        _, i, j = heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != j:
            continue
        end[i], end[middle] = j, 0
        if j < n:
            before[j] = i
            if (r := ranks.get(piece[i : end[j]])) is not None:
                heappush(heap, (r, i, end[j]))
        if (k := before[i]) >= 0 and (r := ranks.get(piece[k:j])) is not None:
            heappush(heap, (r, k, j))
    return [ranks[piece[i : end[i]]] for i in range(n) if end[i]]


class Cutter:
    """Cuts texts into units whose pieces do not depend on their surroundings.

    Where a single space stands between two characters that are not white space, every piece ends
    before it, and the next begins with it.  So a text without other neighbours of spaces is its
    first unit and ``" " + unit`` for each further one, and only distinct units need the
    pattern.  Any other text is cut by the pattern itself.
    """

    def __init__(self, pattern: str):
        self.pieces = regex.compile(pattern).findall
        self._odd = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search

    def spaced(self, text: str) -> bool:
        """Whether ``text.split(" ")`` gives units; if not, the text has to be cut as a whole."""
        if text[:1].isspace() or text[-1:].isspace() or "  " in text:
            return False
        for x in "\n\t\r\x0b\x0c":
            if x in text and (x + " " in text or " " + x in text):
                return False
        return not self._odd(text)

    def units(self, text: str) -> list[str] | None:
        """The units, or None if the text has to be cut as a whole."""
        return text.split(" ") if self.spaced(text) else None


def _at_spaces(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that can be cut at their spaces: (all bytes, units' starts, their ends, units of each)."""
    raw = b" ".join(texts) + b" "
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    return raw, starts, ends, np.diff(np.searchsorted(ends, np.cumsum([len(x) + 1 for x in texts]) - 1), prepend=-1)


def _distinct_pieces(pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(pattern)
        seen: set[str] = set()
        units: set[str] = set()

        def out() -> pa.RecordBatch:
            if units:
                # units side by side are cut as each of them alone
                seen.update(cutter.pieces(" " + " ".join(units)))
            return pa.RecordBatch.from_pydict({"piece": pa.array([x.encode().decode("latin-1") for x in seen], pa.string())})

        for b in slices(batches, "text"):
            for t in b.column("text").to_pylist():
                if not t:
                    continue
                if (cut := cutter.units(t)) is None:
                    seen.update(cutter.pieces(t))
                else:
                    seen.update(cutter.pieces(cut[0]))
                    units.update(cut[1:])
            if len(seen) + len(units) >= TASK_PIECES:
                yield out()
                seen, units = set(), set()
        if seen or units:
            yield out()

    return run


def _long_pieces(ranks_data):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [heap_merges(x.encode("latin-1"), ranks_data.value) for x in b.column("piece").to_pylist()]
            yield pa.RecordBatch.from_pydict({"piece": b.column("piece"), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return run


def piece_table(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text") -> DataFrame:
    """(piece, ids) for every distinct piece of all whole texts, stored."""
    spark = docs.sparkSession
    pieces = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(_distinct_pieces(pattern), "piece string").distinct()
    pieces = stored(pieces, "pieces")
    short = pieces.filter(F.length("piece") <= FOLD_BYTES).select("piece", fold_merges(F.col("piece"), rank_literal(spark, ranks)).alias("ids"))
    long = pieces.filter(F.length("piece") > FOLD_BYTES).mapInArrow(_long_pieces(spark.sparkContext.broadcast(ranks)), "piece string, ids array<int>")
    return stored(short.unionAll(long), "ids")


def _hash_pieces(pieces: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(x) for x in pieces])
    return span_hashes(np.frombuffer(b"".join(pieces), np.uint8), np.concatenate(([0], ends[:-1])), ends)


class PieceFiles:
    """Sorted hash arrays of all pieces, one file per leading bits of the hash."""

    def __init__(self, base: str, bits: int):
        self.base, self.bits, self._open = base, bits, {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def path(self, n: int) -> str:
        return f"{self.base}/{n:06d}.bin"

    def of(self, h: np.ndarray) -> np.ndarray:
        return (h >> U64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)

    def write(self, n: int, pieces: pa.Array, ids: pa.Array) -> None:
        """pieces: binary; ids: lists of 32-bit integers."""
        h = _hash_pieces(pieces.to_pylist())
        order = np.argsort(h, kind="stable")
        pieces, ids = pieces.take(pa.array(order)), ids.take(pa.array(order))
        ends = np.cumsum([pc.binary_length(pieces).to_numpy(), pc.list_value_length(ids).to_numpy() * ID.itemsize], axis=1, dtype="<i8")
        data = b"".join(pieces.to_pylist()) + ids.flatten().to_numpy(zero_copy_only=False).astype(ID).tobytes()
        put_file(self.path(n), np.array([len(h)], "<i8").tobytes() + h[order].astype("<u8").tobytes() + ends.tobytes() + data)

    def _file(self, n: int):
        """(hashes, piece bounds, id bounds, pieces, ids) of one file, mapped into memory."""
        if n not in self._open:
            with open(local_copy(self.path(n)), "rb") as f:
                m = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
            k = int(np.frombuffer(m, "<i8", 1)[0])
            bounds = np.zeros((2, k + 1), np.int64)
            bounds[:, 1:] = np.frombuffer(m, "<i8", 2 * k, 8 + 8 * k).reshape(2, k)
            at = 8 + 24 * k + int(bounds[0, -1])
            ids = np.frombuffer(m, ID, int(bounds[1, -1]) // ID.itemsize, at)
            self._open[n] = np.frombuffer(m, "<u8", k, 8), bounds[0], bounds[1] // ID.itemsize, np.frombuffer(m, np.uint8, int(bounds[0, -1]), 8 + 24 * k), ids
        return self._open[n]

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number of ids of each) of known pieces data[start:end].

        Equal hashes are told apart by the bytes.
        """
        hashes = span_hashes(data, starts, ends)
        distinct, back = np.unique(hashes, return_inverse=True)
        place = np.zeros(len(distinct), np.int64)
        groups = [(n, mine) for n, mine in zip(*_grouped(self.of(distinct), np.arange(len(distinct))), strict=True)] if len(distinct) else []
        for n, mine in groups:
            place[mine] = np.searchsorted(self._file(n)[0], distinct[mine])
        place, number = place[back], self.of(hashes)
        size, first = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        for n, _ in groups:
            h, bounds, id_bounds, pieces, _ids = self._file(n)
            mine = np.flatnonzero(number == n)
            at = np.minimum(place[mine], len(h) - 1)
            for i in np.flatnonzero(~_same(data, starts[mine], ends[mine], pieces, bounds[at], bounds[at + 1])).tolist():
                j, k = mine[i], int(at[i])
                piece = data[starts[j] : ends[j]].tobytes()
                while k < len(h) and h[k] == hashes[j] and pieces[bounds[k] : bounds[k + 1]].tobytes() != piece:
                    k += 1  # another piece of the same hash
                if k == len(h) or h[k] != hashes[j]:
                    raise KeyError(piece)
                at[i] = k
            first[mine], size[mine] = id_bounds[at], id_bounds[at + 1] - id_bounds[at]
        out = np.empty(int(size.sum()), ID)
        to = np.cumsum(size) - size
        for n, _ in groups:
            mine = number == n
            out[ragged(to[mine], size[mine])] = self._file(n)[4][ragged(first[mine], size[mine])]
        return out, size


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each span, one span after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each run of ``sizes`` values."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _same(a: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b: np.ndarray, b_from: np.ndarray, b_to: np.ndarray) -> np.ndarray:
    """Whether a[from:to] and b[from:to] are equal, for many spans at once."""
    size = a_to - a_from
    out = size == b_to - b_from
    size = size[out]
    out[out] = _sums(a[ragged(a_from[out], size)] != b[ragged(b_from[out], size)], size) == 0
    return out


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The distinct ascending keys and the values of each."""
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at].tolist(), np.split(values, at[1:])


def piece_files(table: DataFrame) -> PieceFiles:
    """Write ``table(piece, ids)`` as hash arrays to the shared folder."""
    spark = table.sparkSession
    bits = max(0, int(np.ceil(np.log2(max(1, table.count()) / FILE_PIECES))))
    files = PieceFiles(shared_dir(spark, "piece-files"), bits)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces = [x.encode("latin-1") for x in b.column("piece").to_pylist()]
            if pieces:
                yield pa.RecordBatch.from_pydict({"n": pa.array(files.of(_hash_pieces(pieces)), pa.int32()), "piece": pa.array(pieces, pa.binary()), "ids": b.column("ids")})

    def write(key, rows):
        files.write(key[0].as_py(), rows["piece"].combine_chunks(), rows["ids"].combine_chunks())
        return pa.table({"n": pa.array([key[0].as_py()], pa.int32())})

    table.mapInArrow(place, "n int, piece binary, ids array<int>").groupBy("n").applyInArrow(write, "n int").count()
    return files


@dataclass
class Results:
    """Of encoded spans: numbers of ids, decimal ids with a comma after each, decoded bytes, each
    span after the other, with sizes."""

    counts: np.ndarray
    decimal: np.ndarray
    decimal_size: np.ndarray
    decoded: np.ndarray
    decoded_size: np.ndarray

    def texts(self, data: np.ndarray, size: np.ndarray) -> list[bytes]:
        out, ends = data.tobytes(), [0, *np.cumsum(size).tolist()]
        return [out[a:b] for a, b in zip(ends, ends[1:], strict=False)]


class Tokens:
    """The tokens' bytes and decimal ids as arrays, to write many ids at once."""

    def __init__(self, ranks: dict[bytes, int]):
        by_id: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            by_id[i] = token
        self.bytes = self._packed(by_id)
        self.decimal = self._packed([b"%d," % i for i in range(len(by_id))])

    @staticmethod
    def _packed(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(x) for x in parts], dtype=np.int64)
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size

    @staticmethod
    def _written(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(the entries of the ids, one after another; the size of each)"""
        data, start, size = table
        ids = ids.astype(np.int64)
        return data[ragged(start[ids], size[ids])], size[ids]

    def results(self, ids: np.ndarray, counts: np.ndarray) -> Results:
        """Of spans with so many ids each: decimal ids and decoded bytes (the binary pieces, concatenated)."""
        decimal, each = self._written(ids, self.decimal)
        decoded, own = self._written(ids, self.bytes)
        return Results(counts, decimal, _sums(each, counts), decoded, _sums(own, counts))


class Grown:
    """Spans of bytes, one after another, to which others are added."""

    def __init__(self):
        self.data, self.used = np.empty(1 << 16, np.uint8), 0
        self.starts, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, data: np.ndarray, sizes: np.ndarray) -> None:
        if self.used + len(data) > len(self.data):
            self.data = np.concatenate((self.data[: self.used], np.empty(max(self.used, len(data)), np.uint8)))
        self.data[self.used : self.used + len(data)] = data
        self.starts = np.concatenate((self.starts, self.used + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.used += len(data)


class Units:
    """Results of encoded units, found by the hash of their bytes in a sorted array."""

    def __init__(self):
        self.hashes, self.where = np.empty(0, U64), np.empty(0, np.int64)
        self.counts, self.decimal, self.decoded = np.empty(0, np.int64), Grown(), Grown()

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of ascending hashes, -1 for unknown ones."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.where[at], -1)

    def add(self, h: np.ndarray, found: Results) -> None:
        """Keep the results of new ascending hashes."""
        at = np.searchsorted(self.hashes, h)
        self.hashes = np.insert(self.hashes, at, h)
        self.where = np.insert(self.where, at, np.arange(len(self.counts), len(self.counts) + len(h)))
        self.counts = np.concatenate((self.counts, found.counts))
        self.decimal.add(found.decimal, found.decimal_size)
        self.decoded.add(found.decoded, found.decoded_size)


class Encoder:
    """Encodes whole texts in a worker from the piece files."""

    def __init__(self, files: PieceFiles, pattern: str, ranks: dict[bytes, int]):
        self.files, self.cutter, self.tokens = files, Cutter(pattern), Tokens(ranks)
        self.known = Units()

    def _found(self, text: str, pieces: list[str], parts: np.ndarray) -> Results:
        """Results of the parts of a text, of so many pieces each."""
        data = np.frombuffer(text.encode(), np.uint8)
        byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # of each character
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        ids, each = self.files.find(data, byte[np.concatenate(([0], ends[:-1]))] if len(ends) else ends, byte[ends])
        return self.tokens.results(ids, _sums(each, parts))

    def _whole(self, texts: list[str]) -> Results:
        """Results of texts cut by the pattern."""
        cut = [self.cutter.pieces(t) for t in texts]
        return self._found("".join(texts), [p for pieces in cut for p in pieces], np.array([len(x) for x in cut], np.int64))

    def _further(self, units: list[bytes]) -> Results:
        """Results of ``" " + unit`` for each unit: side by side they are cut as each alone, and
        every unit's first piece is the one that starts with the space."""
        text = (b" " + b" ".join(units)).decode()
        pieces = self.cutter.pieces(text)
        first = np.flatnonzero(np.fromiter((p[0] == " " for p in pieces), bool, len(pieces)))
        return self._found(text, pieces, np.diff(np.append(first, len(pieces))))

    def encode(self, texts: list[str]) -> tuple[list[int], list[bytes], list[bytes]]:
        """(ids, decimal ids with a comma after each, decoded bytes) of each text.

        Texts that can be cut at their spaces are taken apart as one array of bytes.  Units are
        told apart by hash at first; ids decode to what was encoded, so a text whose
        decoded bytes differ held a unit of a known hash and is encoded again piece by piece.
        """
        count, decimal, decoded = [0] * len(texts), [b""] * len(texts), [b""] * len(texts)
        spaced = [bool(t) and self.cutter.spaced(t) for t in texts]
        plain = [i for i, x in enumerate(spaced) if x]
        again = [i for i, (t, x) in enumerate(zip(texts, spaced, strict=True)) if t and not x]
        if plain:
            own = [texts[i].encode() for i in plain]
            for i, x, c, d, e in zip(plain, own, *self._cut_at_spaces(own), strict=True):
                if e == x:
                    count[i], decimal[i], decoded[i] = c, d, e
                else:
                    again.append(i)
        if again:
            r = self._whole([texts[i] for i in again])
            for i, c, d, e in zip(again, r.counts.tolist(), r.texts(r.decimal, r.decimal_size), r.texts(r.decoded, r.decoded_size), strict=True):
                count[i], decimal[i], decoded[i] = c, d, e
        return count, decimal, decoded

    def _cut_at_spaces(self, texts: list[bytes]) -> tuple[list[int], list[bytes], list[bytes]]:
        raw, starts, ends, units = _at_spaces(texts)
        data = np.frombuffer(raw, np.uint8)
        first = np.cumsum(units) - units
        further = np.ones(len(ends), bool)
        further[first] = False
        begun = self._whole([raw[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
        further = np.flatnonzero(further)
        h, one, back = np.unique(span_hashes(data, starts, ends)[further], return_index=True, return_inverse=True)
        place = self.known.find(h)
        new = np.flatnonzero(place < 0)
        fresh = None
        if len(new):
            a, b = starts[further[one[new]]].tolist(), ends[further[one[new]]].tolist()
            fresh = self._further([raw[i:j] for i, j in zip(a, b, strict=True)])
            if len(self.known.counts) + len(new) <= CACHED_UNITS:
                place[new] = np.arange(len(self.known.counts), len(self.known.counts) + len(new))
                self.known.add(h[new], fresh)
                fresh = None
            else:
                place[new] = ~np.arange(len(new))  # places in this batch's own results
        place = place[back]
        stored, kept = further[place >= 0], place[place >= 0]
        counts = np.empty(len(ends), np.int64)
        counts[first], counts[stored] = begun.counts, self.known.counts[kept]
        if fresh is not None:
            mine, at = further[place < 0], ~place[place < 0]
            counts[mine] = fresh.counts[at]

        def joined(what: str) -> list[bytes]:
            known, size = getattr(self.known, what), np.empty(len(ends), np.int64)
            begun_size = getattr(begun, f"{what}_size")
            size[first], size[stored] = begun_size, known.sizes[kept]
            if fresh is not None:
                fresh_size = getattr(fresh, f"{what}_size")
                size[mine] = fresh_size[at]
            to = np.cumsum(size) - size
            out = np.empty(int(size.sum()), np.uint8)
            out[ragged(to[first], begun_size)] = getattr(begun, what)
            out[ragged(to[stored], size[stored])] = known.data[ragged(known.starts[kept], size[stored])]
            if fresh is not None:
                out[ragged(to[mine], size[mine])] = getattr(fresh, what)[ragged((np.cumsum(fresh_size) - fresh_size)[at], size[mine])]
            return begun.texts(out, _sums(size, units))

        return _sums(counts, units).tolist(), joined("decimal"), joined("decoded")


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``docs`` without its text and with ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by
    commas), ``decoded_sha256`` (of the bytes the ids decode to) and, if asked, ``ids`` array<int>.

    A null or empty text has no tokens.  Columns of those names are replaced; every row
    stays, repeated ones too.  There are no special tokens.
    """
    spark = docs.sparkSession
    ranks = read_ranks(ranks_path)
    files = piece_files(piece_table(docs, ranks, pattern, text_col))
    tokens = spark.sparkContext.broadcast(ranks)  # the tokenizer's fixed vocabulary
    new = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    names = [c for c in docs.columns if c not in (*new, text_col)]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(("units", files.base, pattern), lambda: Encoder(files, pattern, tokens.value))
        for b in slices(batches, "__text", holding=True):
            count, decimals, decoded = encoder.encode([t or "" for t in b.column("__text").to_pylist()])
            columns = [
                pa.array(count, pa.int64()),
                pa.array([hashlib.sha256(x[:-1]).hexdigest() for x in decimals], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
            ]
            if with_ids:
                columns.append(pa.array([np.array(x[:-1].split(b",") if x else [], dtype=bytes).astype(np.int32) for x in decimals], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), *columns], names=[*names, *new])

    given = docs.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text_col}`").alias("__text"))
    schema = [*(f"`{c}` {kinds[c]}" for c in names), "n_tokens long", "ids_sha256 string", "decoded_sha256 string", *["ids array<int>"] * with_ids]
    return given.mapInArrow(run, ", ".join(schema))
