"""Interpolated modified Kneser-Ney scores from an n-gram model of any order counted over the corpus.

The model lives in the shared folder as sorted arrays that workers map into memory:

* vocabulary: the sorted 64-bit hashes of the training words, in files by leading bits; a word's
  id is its place.  With them lie its count, what it needs as a context (total, weight left to the
  lower order) and its own lowest-order probability.
* n-grams of each length m from 2: word ids, sorted by context and word, and where each context
  starts.  A context of one word is its id; a longer one is its place among the n-grams of m - 1
  words, and its followers lie in the file of the same number.  Files of two words are ranges of
  equal mass by the counts of the contexts, so a frequent context is split by word.

A text is preceded by one end; an n-gram does not reach beyond it, so the first words of a text
have shorter contexts.  Counts of the longest n-grams and of those that begin with the end of a
text are numbers of occurrences, all others numbers of different words before them.

Counting goes through packed, sorted blocks: each task counts its own n-grams first, so a
frequent one leaves a task once.  All training texts are counted, whole, in one pass for each
length.  Discounts are the usual D1, D2, D3+ of the counts of counts; the lowest order is
interpolated with the uniform distribution over the vocabulary and one unknown word.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom.llm._shared import local_copy, put_file, shared_dir, shuffle_partitions, stored
from motifloom.llm._text import U64, Words, binary, slices, words_of

END = U64(0x9AE16A3B2F90404F)  # stands for the end of a text among the hashes of words
FLUSH_TOKENS = 3_000_000
SLICE_BYTES = 1 << 22  # of text at once
FILE_TOKENS = 1 << 18  # least tokens of a file of n-grams, so that small inputs have few files
UNKNOWN = 0xFFFFFFFF
MISSING = U64(0xFFFFFFFFFFFFFFFF)  # place of an n-gram that is not in the model
LOW = U64(0xFFFFFFFF)
_PACK = "bucket int, data binary"


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, END after each text's words, and each text's first token (with an end)."""
    h, counts = w.hashes(), w.counts
    first = w.first + np.arange(len(w.first))
    out = np.full(len(h) + len(counts), END, dtype=U64)
    keep = np.ones(len(out), dtype=bool)
    keep[first[1:] - 1] = False
    out[keep] = h
    return out, first


def _dump(**arrays: np.ndarray) -> bytes:
    f = io.BytesIO()
    for k, v in arrays.items():
        f.write(k.encode().ljust(16))
        np.lib.format.write_array(f, np.ascontiguousarray(v), allow_pickle=False)
    return f.getvalue()


def _narrow(counts: np.ndarray) -> np.ndarray:
    """32 bits where all counts fit, else 64."""
    return counts.astype(np.uint32 if not len(counts) or counts.max() < 2**32 else np.uint64)


def _planes(x: np.ndarray) -> bytes:
    """Byte planes from the lowest, after their number; those above the largest value are left out."""
    x = x.astype("<u8", copy=False)
    used = -(-int(x.max()).bit_length() // 8) if len(x) else 0
    by_byte = x.view(np.uint8).reshape(-1, 8)
    return bytes([used]) + b"".join(by_byte[:, i].tobytes() for i in range(used))


def _of_planes(raw: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """The ``n`` values whose planes start at a byte, and where these end."""
    used, out = raw[at], np.zeros((n, 8), np.uint8)
    for i in range(used):
        out[:, i] = np.frombuffer(raw, np.uint8, n, at + 1 + i * n)
    return out.view("<u8").ravel(), at + 1 + used * n


def _squeeze(key: np.ndarray, count: np.ndarray) -> bytes:
    """Sorted keys as differences, byte plane by byte plane, with their counts."""
    return zstandard.compress(len(key).to_bytes(8, "little") + _planes(np.diff(key, prepend=key[:1] * 0)) + _planes(count), 3)


def _expand(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    delta, at = _of_planes(raw, 8, n)
    return np.cumsum(delta, dtype=U64), _of_planes(raw, at, n)[0].view("<i8")


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[: len(key)]
    return key[at], np.add.reduceat(count, at) if len(at) else count


def _summed_by_bucket(buckets: list[np.ndarray], keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (bucket, key), ascending, with the sums of their counts.  Keys are sorted within a
    bucket, where most come in a few ascending runs, which a stable sort only merges."""
    bucket, key, count = np.concatenate(buckets), np.concatenate(keys), np.concatenate(counts)
    out = [(k, *_summed([key[mine]], [count[mine]])) for k, mine in _by_file(bucket)]
    return np.repeat(np.array([k for k, _, _ in out], bucket.dtype), [len(x) for _, x, _ in out]), np.concatenate([x for _, x, _ in out]), np.concatenate([x for _, _, x in out])


def _bytes(count: np.ndarray) -> dict[str, np.ndarray]:
    """Counts (rows of one or more) as one byte each; those of 255 and more apart."""
    flat = count.ravel()
    at = np.flatnonzero(flat >= 255)
    return {"small": np.minimum(flat, 255).astype(np.uint8), "at": at, "large": flat[at].astype(np.int64)}


def _wide(a: dict[str, np.ndarray], at: np.ndarray | slice = slice(None), width: int = 1) -> np.ndarray:
    """Rows of ``width`` counts that `_bytes` has packed, all or those at given places."""
    rows = a["small"].reshape(-1, width)
    rows = rows[at] if isinstance(at, slice) else rows.take(at, axis=0)
    out = rows.astype(np.int64)
    if len(a["at"]) and len(flat := np.flatnonzero(rows == 255)):
        row, column = np.divmod(flat, width)
        place = row if isinstance(at, slice) else at[row]
        out[row, column] = a["large"][np.searchsorted(a["at"], place * width + column)]
    return out


def _distinct(context: np.ndarray, word: np.ndarray, contexts: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of numbers below ``contexts`` and ``words``, ascending, a place of each, and
    which one is at each place.  Where a pair and its place fit 64 bits, these are sorted as one."""
    low, bits = U64(max(words - 1, 0).bit_length()), U64(max(len(word) - 1, 0).bit_length())
    key = (context.astype(U64) << low) | word.astype(U64)
    if max(contexts - 1, 0).bit_length() + int(low) + int(bits) <= 64:
        key = np.sort((key << bits) | np.arange(len(key), dtype=U64))
        order = (key & ((U64(1) << bits) - U64(1))).astype(np.int64)
        key >>= bits
    else:
        order = np.argsort(key)
        key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
    place = np.empty(len(key), np.int64)
    place[order] = np.cumsum(new) - 1
    key = key[new]
    return (key >> low).astype(np.int64), (key & ((U64(1) << low) - U64(1))).astype(np.int64), order[new], place


def _find(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``want`` lies in the ascending stretches ``words[lo:hi]``, and whether it is there."""
    want, out = want.astype(words.dtype), lo.copy()
    live = np.flatnonzero(hi - lo > 1)
    at, left, sought = lo[live], (hi - lo)[live], want[live]
    while len(live):
        for _ in range(4):  # a stretch of one stays as it is
            half = left >> 1
            at += half * (words[at + half - 1] < sought)
            left -= half
        out[live] = at
        more = np.flatnonzero(left > 1)
        live, at, left, sought = live[more], at[more], left[more], sought[more]
    ok = lo < hi
    ok[ok] = words[out[ok]] == want[ok]
    return out, ok


def _by_file(where: np.ndarray) -> Iterator[tuple[int, np.ndarray | slice]]:
    """Each file's number and the places that hold it, as a slice where they ascend."""
    order = None
    if not len(where):
        return
    if (where[1:] < where[:-1]).any():
        order = np.argsort(where, kind="stable")
        where = where[order]
    at = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    for a, b in zip(at.tolist(), np.append(at[1:], len(where)).tolist(), strict=True):
        yield int(where[a]), slice(a, b) if order is None else order[a:b]


def _starts(context: np.ndarray, contexts: int) -> np.ndarray:
    """Where each of ``contexts`` contexts starts among ascending ones, and the end."""
    out = np.concatenate(([0], np.cumsum(np.bincount(context, minlength=contexts))))
    return out.astype(np.uint32 if out[-1] < 2**32 else np.int64)


def _blocks(key: np.ndarray, count: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """One packed row per bucket; key and bucket ascend together."""
    at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    ends = np.append(at[1:], len(key))
    return pa.RecordBatch.from_pydict({
        "bucket": pa.array(bucket[at], pa.int32()),
        "data": pa.array([_squeeze(key[a:b], count[a:b]) for a, b in zip(at, ends, strict=True)], pa.binary()),
    })


class Model:
    """Where the arrays are, the discounts, and lookups in a worker."""

    def __init__(self, base: str, order: int):
        self.base = base
        self.order = order
        self.bits = 0
        self.first = np.zeros(1, np.int64)  # id of each vocabulary file's first word; the vocabulary's size at the end
        self.train_tokens = 0
        self.edges = np.zeros(0, U64)  # least bigram (context id << 32 | word id) of each file
        self.low = np.zeros(4)  # discounts of the lowest order
        self.cuts: dict[int, np.ndarray] = {}  # and of the others, by length
        self.low_total = 0
        self.low_rest = 1.0
        self._open: dict[str, dict[str, np.ndarray]] = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    @property
    def words(self) -> int:
        return int(self.first[-1])

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        if name not in self._open:
            path, out = local_copy(f"{self.base}/{name}"), {}
            with open(path, "rb") as f:
                while key := f.read(16).strip().decode():
                    np.lib.format.read_magic(f)
                    shape, _, dtype = np.lib.format.read_array_header_1_0(f)
                    at, n = f.tell(), int(np.prod(shape))
                    out[key] = np.memmap(path, dtype, "r", at, (n,)).view(np.ndarray) if n else np.zeros(0, dtype)
                    f.seek(at + n * dtype.itemsize)
            self._open[name] = out
        return self._open[name]

    def part(self, h: np.ndarray) -> np.ndarray:
        return (h >> U64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Ids of ascending hashes; UNKNOWN if not in the vocabulary."""
        out = np.full(len(h), UNKNOWN, dtype=U64)
        where = self.part(h)
        for n in np.unique(where).tolist():
            a, b = np.searchsorted(where, [n, n + 1])
            table = self.arrays(f"words-{n}")["hash"]
            if len(table):
                at = np.minimum(np.searchsorted(table, h[a:b]), len(table) - 1)
                out[a:b] = np.where(table[at] == h[a:b], at + int(self.first[n]), UNKNOWN)
        return out

    def of_words(self, ids: np.ndarray, kind: str, name: str, fill: float) -> np.ndarray:
        """Values from the files ``kind``-n of ids that ascend but for UNKNOWN, which has ``fill``."""
        out = np.full(len(ids), fill)
        known = np.flatnonzero(ids != UNKNOWN)
        own = ids[known].astype(np.int64)
        where = np.searchsorted(self.first, own, side="right") - 1
        for n in np.unique(where).tolist():
            a, b = np.searchsorted(where, [n, n + 1])
            out[known[a:b]] = self.arrays(f"{kind}-{n}")[name][own[a:b] - int(self.first[n])]
        return out

    def places(self, m: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """File and place (file << 32 | place) of n-grams of ``m`` words given by their contexts'
        ids or places and their last words' ids; MISSING if not in the model."""
        out = np.full(len(word), MISSING)
        known = np.flatnonzero((word != UNKNOWN) & (context != (UNKNOWN if m == 2 else MISSING)))
        context, word = context[known], word[known]
        where = np.searchsorted(self.edges, (context << U64(32)) | word, side="right") - 1 if m == 2 else (context >> U64(32)).astype(np.int64)
        for n, mine in _by_file(where):
            g = self.arrays(f"grams{m}-{n}")
            own = (context[mine].astype(np.int64) - int(g["base"][0])) if m == 2 else (context[mine] & LOW).astype(np.int64)
            last, to = word[mine], known[mine]
            inside = (own >= 0) & (own < len(g["start"]) - 1)
            if not inside.all():
                own, last, to = own[inside], last[inside], to[inside]
            place, ok = _find(g["word"], g["start"][own].astype(np.int64), g["start"][own + 1].astype(np.int64), last)
            out[to[ok]] = (U64(n) << U64(32)) | place[ok].astype(U64)
        return out

    def of_places(self, kind: str, places: np.ndarray, width: int = 1) -> np.ndarray:
        """Rows of ``width`` packed counts of the files ``kind``-n at places; 0 where MISSING."""
        out = np.zeros((len(places), width), np.int64)
        known = np.flatnonzero(places != MISSING)
        for n, mine in _by_file((places[known] >> U64(32)).astype(np.int64)):
            mine = known[mine]
            out[mine] = _wide(self.arrays(f"{kind}-{n}"), (places[mine] & LOW).astype(np.int64), width)
        return out

    def grams(self, own: np.ndarray, first: np.ndarray, end: int, ids: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each length from 2: (length, tokens that end an n-gram of it, a token of each
        distinct n-gram, which one each token ends, its context and its last word, each as a number
        among the distinct shorter n-grams and words).  ``own``: each token's distinct word."""
        rank = np.arange(len(own)) - np.repeat(first[:-1], np.diff(first))
        before, contexts, words = own, len(ids), len(ids)
        for m in range(2, longest + 1):
            at = np.flatnonzero(rank >= m - 2)
            context = before[np.maximum(at - 1, 0)]
            if m == 2:
                context[rank[at] == 0] = end
            context, word, sample, place = _distinct(context, own[at], contexts, words)
            yield m, at, at[sample], place, context, word
            before, contexts = np.zeros(len(own), np.int64), len(context)
            before[at] = place

    def score(self, w: Words) -> dict[str, np.ndarray]:
        """Per text: n_tokens, n_known, base and score (log10)."""
        h, first = tokens(w)
        distinct, own = np.unique(h, return_inverse=True)
        ids = self.ids(distinct)
        count = self.of_words(ids, "words", "count", 0.0)
        base = np.log10((count + 1) / (self.train_tokens + self.words + 1))[own]
        chance = self.of_words(ids, "model", "lower", self.low_rest / (self.words + 1))[own]
        total = self.of_words(ids, "model", "total", 0.0)
        rest = self.of_words(ids, "model", "rest", 1.0)
        places = ids
        for m, tails, sample, place, context, word in self.grams(own, first, int(np.searchsorted(distinct, END)), ids, self.order if self.words else 1):
            found = self.places(m, places[context], ids[word])
            seen = self.of_places(f"counts{m}", found)[:, 0]
            cut = self.cuts[m][np.minimum(seen, 3)]
            t, lower = total[context], chance[sample]
            chance[tails] = np.where(t > 0, np.maximum(seen - cut, 0) / np.maximum(t, 1) + rest[context] * lower, lower)[place]
            places = found
            if m < self.order:
                total, rest = self.left(m, places)
        at = first[:-1]
        return {
            "n_tokens": np.diff(first), "n_known": np.add.reduceat((count > 0)[own].astype(np.int64), at),
            "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(np.log10(chance), at),
        }

    def left(self, m: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Totals of the contexts at places, and the weights that they leave to the lower order."""
        after = self.of_places(f"after{m}", places, 4)
        cut = self.cuts[m + 1]
        return after[:, 0], (after[:, 1] * cut[1] + after[:, 2] * cut[2] + after[:, 3] * cut[3]) / np.maximum(after[:, 0], 1)


def discounts(n: np.ndarray) -> np.ndarray:
    """[0, D1, D2, D3+] from the numbers of things counted 1, 2, 3 and 4 times; where these are
    too few for the formula, half the count is taken."""
    n1, n2, n3, n4 = (float(x) for x in n)
    out = np.array([0.0, 0.5, 1.0, 1.5])
    if n1 and n2:
        y = n1 / (n1 + 2 * n2)
        found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n3 else 1.0, 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5]
        out[1:] = [min(max(d, 1e-3), k) for d, k in zip(found, (0.999, 1.999, 2.999), strict=True)]
    return out


def _count_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, n = [], [], 0

        def out() -> pa.RecordBatch:
            key, count = _summed(keys, counts)
            return _blocks(key, count, (key >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64))

        for b in slices(batches, "text", SLICE_BYTES):
            h, _ = tokens(words_of(binary(b.column("text")), lower=True))
            k, c = np.unique(h, return_counts=True)
            keys.append(k)
            counts.append(c)
            n += len(k)
            if n >= FLUSH_TOKENS:
                yield out()
                keys, counts, n = [], [], 0
        if keys:
            yield out()

    return run


def _count_grams(shared, m: int):
    """Blocks of n-grams of ``m`` words: bigrams by ranges, longer ones by the file of their context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, bounds = shared.value
        buckets, keys, counts, n = [], [], [], 0

        def out() -> pa.RecordBatch:
            bucket, key, count = _summed_by_bucket(buckets, keys, counts)
            return _blocks(key, count, bucket)

        for b in slices(batches, "text", SLICE_BYTES):
            h, first = tokens(words_of(binary(b.column("text")), lower=True))
            distinct, own = np.unique(h, return_inverse=True)
            ids = model.ids(distinct)
            places = ids
            for length, _, _, place, context, word in model.grams(own, first, int(np.searchsorted(distinct, END)), ids, m):
                if length < m:
                    places = model.places(length, places[context], ids[word])
                    continue
                key = ((places[context] & LOW) << U64(32)) | ids[word]
                buckets.append((np.searchsorted(bounds, key, side="right") - 1 if m == 2 else (places[context] >> U64(32))).astype(np.int32))
                keys.append(key)
                counts.append(np.bincount(place, minlength=len(key)))
                n += len(key)
            if n >= FLUSH_TOKENS:
                yield out()
                buckets, keys, counts, n = [], [], [], 0
        if n:
            yield out()

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, keys, counts) of the buckets in this partition, one in memory at a time."""
    held: dict[int, list[bytes]] = {}
    for b in batches:
        for k, x in zip(b.column("bucket").to_pylist(), b.column("data").to_pylist(), strict=True):
            held.setdefault(k, []).append(x)
    for k in sorted(held):
        parts = [_expand(x) for x in held.pop(k)]
        yield k, *_summed([p[0] for p in parts], [p[1] for p in parts])


def train(docs: DataFrame, order: int = 3, text_col: str = "text") -> Model:
    """Count ``docs`` and write a model of n-grams of up to ``order`` words (1 or more); a null text
    is an empty one (one end token)."""
    if order < 1:
        raise ValueError(f"order {order}; 1 is the least")
    spark: SparkSession = docs.sparkSession
    base = shared_dir(spark, "kneser-ney")
    model = Model(base, order)
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))
    parts = shuffle_partitions(spark)
    model.bits = bits = max(0, int(np.ceil(np.log2(parts))))

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, key, count in _by_bucket(batches):
            put_file(f"{base}/words-{k}", _dump(hash=key, count=count))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([k], pa.int32()), "n": pa.array([len(key)], pa.int64()), "total": pa.array([int(count.sum())], pa.int64())})

    packed = texts.mapInArrow(_count_words(bits), _PACK)
    done = stored(packed.repartition("bucket").mapInArrow(write_words, "bucket int, n long, total long"), "words").collect()  # one row per file
    sizes, totals = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    for r in done:
        sizes[r["bucket"]], totals[r["bucket"]] = r["n"], r["total"]
    for k in np.flatnonzero(sizes == 0).tolist():
        put_file(f"{base}/words-{k}", _dump(hash=np.zeros(0, U64), count=np.zeros(0, np.int64)))
    model.first = np.concatenate(([0], np.cumsum(sizes)))
    model.train_tokens = int(totals.sum())
    if model.words >= UNKNOWN:
        raise ValueError(f"{model.words} different words; ids have 32 bits")
    if not model.train_tokens:
        return model

    # borders of equal mass among the bigram keys: contexts by their counts, a heavy context by word
    buckets = max(1, min(4 * parts, model.train_tokens // FILE_TOKENS))
    step = model.train_tokens / buckets

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, before in zip(b.column("bucket").to_pylist(), b.column("before").to_pylist(), strict=True):
                mass = before + np.cumsum(model.arrays(f"words-{k}")["count"])
                start = np.concatenate(([before], mass[:-1]))
                marks = np.arange(np.ceil(before / step), np.ceil(mass[-1] / step)) * step
                at = np.searchsorted(mass, marks, side="right")
                share = (marks - start[at]) / (mass[at] - start[at])
                key = ((at + int(model.first[k])).astype(U64) << U64(32)) | (share * model.words).astype(U64)
                yield pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64))})

    before = np.concatenate(([0], np.cumsum(totals)[:-1]))
    jobs = spark.createDataFrame([(int(k), int(before[k])) for k in np.flatnonzero(sizes)], "bucket int, before long").repartition(min(parts, 64))
    found = np.sort(np.array([r["key"] for r in jobs.mapInArrow(borders, "key long").collect()], dtype=np.int64).view(U64))  # `buckets` numbers
    bounds = np.unique(np.concatenate((np.zeros(1, U64), found)))
    spark_context = spark.sparkContext
    def write_grams(m: int):
        counts = "counts" if m == order else "raw"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for k, key, count in _by_bucket(batches):
                if len(key) >= UNKNOWN:
                    raise ValueError(f"{len(key)} n-grams in one file; places have 32 bits: use more shuffle partitions")
                context = (key >> U64(32)).astype(np.int64)
                least, contexts = (int(context[0]), int(context[-1] - context[0]) + 1) if m == 2 else (0, len(model.arrays(f"grams{m - 1}-{k}")["word"]))
                put_file(f"{base}/grams{m}-{k}", _dump(word=(key & LOW).astype(np.uint32), start=_starts(context - least, contexts), base=np.array([least])))
                put_file(f"{base}/{counts}{m}-{k}", _dump(**_bytes(count)))
                yield from _stats(model, m, k, count if m == order else None)

        return run

    def write_counts(m: int):
        """Numbers of different words before n-grams; none is before a text's end, whose n-grams keep theirs."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for k, key, times in _by_bucket(batches):
                count = _wide(model.arrays(f"raw{m}-{k}"))[:, 0]
                context, start = (key >> U64(32)).astype(np.int64), model.arrays(f"grams{m}-{k}")
                own = context - int(start["base"][0])
                place, _ = _find(start["word"], start["start"][own].astype(np.int64), start["start"][own + 1].astype(np.int64), key & LOW)
                count[place[times > 0]] = times[times > 0]
                put_file(f"{base}/counts{m}-{k}", _dump(**_bytes(count)))
                yield from _stats(model, m, k, count)

        return run

    stat = "kind string, part int, data binary"
    files = list(range(len(bounds)))  # the same numbers at each length
    have: dict[int, list[int]] = {}  # those that are not empty
    if order == 1:
        jobs = spark.createDataFrame([(int(k),) for k in np.flatnonzero(sizes)], "bucket int").repartition(min(parts, 64))
        stats = stored(jobs.mapInArrow(_word_stats(model), stat), "gram-stats")
    for m in range(2, order + 1):
        grams = texts.mapInArrow(_count_grams(spark_context.broadcast((model, bounds)), m), _PACK)
        stats = stored(grams.repartition("bucket").mapInArrow(write_grams(m), stat), "gram-stats")
        have[m] = [r["part"] for r in stats.filter("kind = 'n'").select("part").collect()]  # one row per file
        for k in set(files) - set(have[m]):
            put_file(f"{base}/grams{m}-{k}", _dump(word=np.zeros(0, np.uint32), start=np.zeros(1, np.uint32), base=np.zeros(1, np.int64)))
        if m == 2:
            model.edges = bounds
        if m == order:
            model.cuts[m] = _cuts(stats)
    for m in range(order - 1, 1, -1):
        jobs = spark.createDataFrame([(k, True) for k in have[m + 1]] + [(k, False) for k in have[m]], "bucket int, source boolean").repartition(min(parts, len(files)))
        before = jobs.mapInArrow(_preceded(spark_context.broadcast(model), m), _PACK)
        stats = stored(before.repartition("bucket").mapInArrow(write_counts(m), stat), "gram-stats")
        model.cuts[m] = _cuts(stats)
    for m in range(2, order):
        spark.createDataFrame([(k,) for k in have[m]], "bucket int").repartition(min(4 * parts, len(files))).mapInArrow(_write_after(model, m), "bucket int").count()

    merged = stats.filter("kind <> 'n'")
    counts = merged.filter("kind = 'word'").groupBy("part").applyInArrow(_word_counts(model), "part int, data binary")
    n = np.zeros(6, np.int64)  # how many were counted 0, 1, 2, 3, 4 and more times
    total = np.zeros(2, np.int64)
    for r in counts.collect():  # eight numbers per vocabulary file
        x = np.frombuffer(bytes(r["data"]), "<i8")
        n += x[:6]
        total += x[6:]
    model.low, model.low_total = discounts(n[1:5]), int(total[0])
    # what the lowest order leaves to the uniform distribution
    spent = n[1:3] @ model.low[1:3] + n[3:].sum() * model.low[3]
    model.low_rest = float(spent / model.low_total)
    merged.groupBy("part").applyInArrow(_write_model(model), "part int, data binary").count()
    return model


def _stats(model: Model, m: int, k: int, count: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Rows of file ``k``: how many n-grams were counted 0, 1, 2, 3, 4 and more times; of bigrams also
    per context its total and its numbers of followers counted 1, 2, 3+ times, and per word in how
    many contexts it is.  Without counts yet only the first, empty."""
    low = np.zeros(6, np.int64) if count is None else np.bincount(np.minimum(count, 5), minlength=6)
    yield pa.RecordBatch.from_pydict({"kind": pa.array(["n"]), "part": pa.array([k], pa.int32()), "data": pa.array([low.astype("<i8").tobytes()], pa.binary())})
    if m == 2 and count is not None:
        g = model.arrays(f"grams2-{k}")
        sizes = np.diff(g["start"].astype(np.int64))
        context = np.flatnonzero(sizes)
        at = g["start"][context].astype(np.int64)
        kinds = [np.add.reduceat(x.astype(np.int64), at) for x in (count, count == 1, count == 2, count >= 3)]
        yield from _dealt("context", model.first, context + int(g["base"][0]), np.stack(kinds, axis=1))
        word, times = np.unique(g["word"].astype(np.int64), return_counts=True)
        yield from _dealt("word", model.first, word, times[:, None])


def _word_stats(model: Model):
    """Per word its count, which stands for the contexts where the order is 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column("bucket").to_pylist():
                count = model.arrays(f"words-{k}")["count"]
                yield from _dealt("word", model.first, np.arange(len(count)) + int(model.first[k]), count[:, None])

    return run


def _cuts(stats: DataFrame) -> np.ndarray:
    n = sum((np.frombuffer(bytes(r["data"]), "<i8") for r in stats.filter("kind = 'n'").collect()), np.zeros(6, np.int64))  # one row per file
    return discounts(n[1:5])


def _preceded(shared, m: int):
    """Blocks of the n-grams of ``m`` words at the end of those of ``m + 1``, with how many these are;
    files that are no source send their first n-gram with 0, so that each is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value

        def contexts(g: dict[str, np.ndarray]) -> np.ndarray:
            return np.repeat(np.arange(len(g["start"]) - 1), np.diff(g["start"].astype(np.int64)))

        def suffix(length: int, k: int) -> np.ndarray:
            """Id or place of each n-gram without its first word."""
            g = model.arrays(f"grams{length}-{k}")
            word = g["word"].astype(U64)
            return word if length == 2 else model.places(length - 1, suffix(length - 1, k)[contexts(g)], word)

        buckets, keys, times, n = [], [], [], 0

        def out() -> pa.RecordBatch:
            bucket, key, count = _summed_by_bucket(buckets, keys, times)
            return _blocks(key, count, bucket)

        for b in batches:
            for k, source in zip(b.column("bucket").to_pylist(), b.column("source").to_pylist(), strict=True):
                g = model.arrays(f"grams{m + source}-{k}")
                context, word = contexts(g), g["word"].astype(U64)
                if source:
                    context = suffix(m, k)[context]
                    key = ((context & LOW) << U64(32)) | word
                    bucket = (np.searchsorted(model.edges, key, side="right") - 1 if m == 2 else context >> U64(32)).astype(np.int32)
                else:
                    key = ((context[:1] + int(g["base"][0])).astype(U64) << U64(32)) | word[:1]
                    bucket = np.full(1, k, np.int32)
                buckets.append(bucket)
                keys.append(key)
                times.append(np.full(len(key), int(source)))
                n += len(key)
                if n >= FLUSH_TOKENS:
                    yield out()
                    buckets, keys, times, n = [], [], [], 0
        if n:
            yield out()

    return run


def _write_after(model: Model, m: int):
    """For n-grams of ``m`` words as contexts: totals, and followers counted 1, 2, 3+ times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column("bucket").to_pylist():
                start = model.arrays(f"grams{m + 1}-{k}")["start"].astype(np.int64)
                after = np.zeros((len(model.arrays(f"grams{m}-{k}")["word"]), 4), np.int64)
                context = np.flatnonzero(np.diff(start))
                if len(context):
                    count = _wide(model.arrays(f"counts{m + 1}-{k}"))[:, 0]
                    for column, x in enumerate((count, count == 1, count == 2, count >= 3)):
                        after[context, column] = np.add.reduceat(x.astype(np.int64), start[context])
                put_file(f"{model.base}/after{m}-{k}", _dump(**_bytes(after)))
            yield b

    return run


def _dealt(kind: str, first: np.ndarray, ids: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (kind, part, data): ascending ids and their values, by vocabulary file."""
    part = np.searchsorted(first, ids, side="right") - 1
    at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    blobs = [zstandard.compress(_dump(id=(ids[a:b] - first[part[a]]).astype(np.uint32), value=_narrow(values[a:b].ravel())), 1) for a, b in zip(at, np.append(at[1:], len(ids)), strict=True)]
    yield pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(at)), "part": pa.array(part[at], pa.int32()), "data": pa.array(blobs, pa.binary())})


def _load(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    f, out = io.BytesIO(zstandard.decompress(blob)), []
    while f.read(16):
        out.append(np.lib.format.read_array(f, allow_pickle=False))
    return out[0].astype(np.int64), out[1].astype(np.int64)


def _sums(model: Model, part: int, blobs: list[bytes], width: int) -> np.ndarray:
    total = np.zeros((int(model.first[part + 1] - model.first[part]), width), dtype=np.int64)
    for x in blobs:
        ids, values = _load(x)
        total[ids] += values.reshape(-1, width)
    return total


def _word_counts(model: Model):
    def run(key, rows):
        part = key[0].as_py()
        times = _sums(model, part, rows["data"].to_pylist(), 1)[:, 0]
        out = np.concatenate((np.bincount(np.minimum(times, 5), minlength=6), [times.sum(), len(times)])).astype("<i8")
        return pa.table({"part": pa.array([part], pa.int32()), "data": pa.array([out.tobytes()], pa.binary())})

    return run


def _write_model(model: Model):
    def run(key, rows):
        part = key[0].as_py()
        kind = np.array(rows["kind"].to_pylist())
        data = rows["data"].to_pylist()
        times = _sums(model, part, [d for d, k in zip(data, kind, strict=True) if k == "word"], 1)[:, 0]
        seen = _sums(model, part, [d for d, k in zip(data, kind, strict=True) if k == "context"], 4)
        lower = np.maximum(times - model.low[np.minimum(times, 3)], 0) / model.low_total + model.low_rest / (model.words + 1)
        rest = (seen[:, 1:] @ model.cuts.get(2, model.low)[1:]) / np.maximum(seen[:, 0], 1)
        put_file(f"{model.base}/model-{part}", _dump(lower=lower, total=seen[:, 0].astype(float), rest=rest))
        return pa.table({"part": pa.array([part], pa.int32()), "data": pa.array([b""], pa.binary())})

    return run


def score_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without its text and with n_tokens, n_known, train_tokens, base_score and score.

    A null text is an empty one: its only token is the end.  Words that were not in training
    share one unknown word's probability.  Without any training token every word is
    unknown and both scores are those of the uniform distribution.  Columns of those
    names are replaced.
    """
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    names = [c for c in docs.columns if c not in (*new, text_col)]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, "__text", SLICE_BYTES):
            s = m.score(words_of(binary(b.column("__text")), lower=True))
            columns = [pa.array(s["n_tokens"], pa.int64()), pa.array(s["n_known"], pa.int64()), pa.array(np.full(b.num_rows, m.train_tokens), pa.int64()), pa.array(s["base_score"], pa.float64()), pa.array(s["score"], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), *columns], names=[*names, *new])

    given = docs.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text_col}`").alias("__text"))
    schema = [*(f"`{c}` {kinds[c]}" for c in names), "n_tokens long", "n_known long", "train_tokens long", "base_score double", "score double"]
    return given.mapInArrow(run, ", ".join(schema))
