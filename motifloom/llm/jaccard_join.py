"""Similarity join of documents on word shingles, with adaptive multi-match prefixes.

A document's set holds its distinct shingles of ``size`` consecutive words (the whole sequence,
if shorter).  Two documents link when |A n B| / |A u B| >= threshold.

1. Copies (equal word sequences) are one class and are represented once.
2. Shingles are ordered by how common they are, rare ones first, from a counting sketch of fixed
   size, and then by hash.  If two sets of n and m shingles link, their l-prefixes (the first
   n - ceil(t n) + l and m - ceil(t m) + l) share l shingles, for every l.  Each document takes
   the l of the smallest estimated cost: longer prefixes put more rows in the lists, but each
   candidate then needs more shared shingles before it is verified.
3. Prefix shingles meet by hash.  Within a list every member is first paired only with the
   list's LEADERS leaders, these pairs are verified on the full sets, and links become
   components.
4. Only pairs that are still in different components can change the result: all of these that
   share enough prefix shingles are verified as well.  So no link between components is lost,
   and a large group of near copies costs about its size, not its square.

That finds components only.  ``jaccard_link_counts`` verifies every candidate pair instead, so
its cost grows with the number of links.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.llm._shared import shuffle_partitions, stored
from motifloom.llm._text import U64, binary, mix, runs_hash, slices, words_of
from motifloom.llm.components import connected_components

SLOT_BITS = 22
CHUNK_BITS = 18
LEADERS = 3
MOST_MATCHES = 3
VERIFY_COST = 8.0
FLUSH_ROWS = 1_500_000
FILTER_BITS = 26  # 8 MB
HOT_ROWS = 1000
SALTS = 64
_HASH_BITS = 58


def _shingles(w, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(class, distinct shingle hashes of _HASH_BITS bits, ascending) of each text with words."""
    h = w.hashes()
    grams = runs_hash(h, size) >> U64(64 - _HASH_BITS)
    for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
        if a == b:
            yield 0, np.empty(0, U64)
            continue
        own = w.data[w.starts[a] : w.ends[b - 1]]
        key = np.array([xxhash.xxh3_64_intdigest(own)], dtype=U64).view(np.int64)[0]
        if b - a < size:
            yield int(key), np.array([xxhash.xxh3_64_intdigest(own, seed=9)], dtype=U64) >> U64(64 - _HASH_BITS)
        else:
            yield int(key), np.unique(grams[a : b - size + 1])


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> U64(_HASH_BITS - SLOT_BITS)).astype(np.int64)


def _profile(size: int):
    """One row per document (doc_id, cls, n) and the chunks of the task's sketch (chunk, data)."""
    schema = pa.schema([("doc_id", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()), ("chunk", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(1 << SLOT_BITS, dtype=np.uint32), set()
        for b in slices(batches, "text"):
            cls, n, new = [], [], []
            for key, h in _shingles(words_of(binary(b.column("text")), lower=True), size):
                cls.append(key if len(h) else None)
                n.append(len(h))
                if len(h) and key not in seen:
                    seen.add(key)
                    new.append(h)
            if new:
                slots, times = np.unique(_slots(np.concatenate(new)), return_counts=True)
                total[slots] += times.astype(np.uint32)
            k = len(n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=schema)
        if seen:
            parts = total.reshape(-1, 1 << CHUNK_BITS)
            k = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(range(k), pa.int32()), pa.array([zstandard.compress(p.tobytes(), 1) for p in parts], pa.binary())],
                schema=schema,
            )

    return run


def _sum_chunks(key, batches):
    total = np.zeros(1 << CHUNK_BITS, dtype=np.uint64)
    for x in batches["data"]:
        total += np.frombuffer(zstandard.decompress(x.as_py()), dtype=np.uint32)
    level = np.floor(np.log2(total + 1.0)).astype(np.uint8)
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([zstandard.compress(level.tobytes())], pa.binary()), "total": pa.array([int(total.sum())], pa.int64())})


def choose_matches(levels: np.ndarray, n: int, need: int, common: float) -> int:
    """The l of the smallest estimated cost for a set of n shingles in order (levels: log2 of
    the sketch's counts), of which any partner shares at least ``need``."""
    base = n - need
    top = min(MOST_MATCHES, need)
    count = np.maximum(np.exp2(levels[: base + top].astype(float)) - common, 1.0)
    scan = np.cumsum(count)[base : base + top]
    return 1 + int(np.argmin(scan * (1 + VERIFY_COST / 4.0 ** np.arange(top))))


def ordered_prefix(h: np.ndarray, level: np.ndarray, num: int, den: int, common: float) -> tuple[np.ndarray, int]:
    """(shingles of the prefix in order, the l chosen)."""
    n = len(h)
    need = -(-n * num // den)
    lv = level[_slots(h)]
    key = (lv.astype(U64) << U64(_HASH_BITS)) | h
    take = n - need + min(MOST_MATCHES, need)
    order = np.argpartition(key, take - 1)[:take] if take < n else np.arange(n)
    order = order[np.argsort(key[order])]
    matches = choose_matches(lv[order], n, need, common)
    return h[order[: n - need + matches]], matches


def _prefix_rows(size: int, num: int, den: int, buckets: int, level_data, common: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(zstandard.decompress(level_data.value), dtype=np.uint8)
        seen: set[int] = set()
        held: list[tuple[np.ndarray, int, int]] = []  # prefix, class, n << 32 | l
        rows = 0
        for b in slices(batches, "text"):
            for cls, h in _shingles(words_of(binary(b.column("text")), lower=True), size):
                if not len(h) or cls in seen:
                    continue
                seen.add(cls)
                t, matches = ordered_prefix(h, level, num, den, common)
                held.append((t, cls, (len(h) << 32) | matches))
                rows += len(t)
            if rows >= FLUSH_ROWS:
                yield from _flush(held, buckets)
                held, rows = [], 0
        if held:
            yield from _flush(held, buckets)

    return run


def _flush(held, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, data): the prefix shingles of many documents, packed by bucket."""
    sizes = [len(x[0]) for x in held]
    token = np.concatenate([x[0] for x in held])
    cls = np.repeat(np.array([x[1] for x in held], dtype=np.int64), sizes)
    info = np.repeat(np.array([x[2] for x in held], dtype=np.int64), sizes) | (np.concatenate([np.arange(k) for k in sizes]) << 4)
    bucket = (mix(token) % U64(buckets)).astype(np.int64)
    order = np.lexsort((token, bucket))
    token, cls, info, bucket = token[order], cls[order], info[order], bucket[order]
    edges = np.append(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), len(bucket))
    squeeze = zstandard.ZstdCompressor(level=1)
    ids, blobs = [], []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        ids.append(int(bucket[a]))
        # byte planes: the bytes that vary little sit together
        planes = b"".join(np.ascontiguousarray(x[a:b]).view(np.uint8).reshape(-1, 8).T.tobytes() for x in (token.astype("<u8"), cls.astype("<i8"), info.astype("<i8")))
        blobs.append(squeeze.compress(struct.pack("<q", b - a) + planes))
        if len(ids) == 64:
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(ids, pa.int32()), "data": pa.array(blobs, pa.binary())})
            ids, blobs = [], []
    if ids:
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(ids, pa.int32()), "data": pa.array(blobs, pa.binary())})


def _unpack(blob: bytes) -> np.ndarray:
    raw = zstandard.decompress(blob)
    (n,) = struct.unpack_from("<q", raw)
    planes = np.frombuffer(raw, dtype=np.uint8, offset=8).reshape(3, 8, n)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).reshape(3, -1).view("<i8").reshape(3, n)


def _parts(info: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set size, position in the order from 0, l) of packed numbers."""
    return info >> 32, (info & 0xFFFFFFFF) >> 4, info & 15


def may_link(n, pos, matches, m, at, others, num: int, den: int) -> np.ndarray:
    """Whether a shared shingle at positions ``pos`` and ``at`` can be one of the first l shared.

    Sets of n and m that link share o >= num (n + m) / (num + den).  The k-th shared shingle has
    o - k more behind it in both, so for k <= l at least o - l + 1 places are left from it on.
    """
    need = -(-num * (n + m) // (num + den))
    left = np.minimum(n - pos, m - at)
    return (left >= need - np.minimum(matches, others) + 1) & (np.minimum(n, m) * den >= np.maximum(n, m) * num)


_LIST = "token long, cls long, info long, other long"


def _lists(num: int, den: int):
    """Rows of _LIST: members of each list of two or more classes (other null), and pairs of a
    list's leader (cls) with its members (other)."""
    schema = pa.schema([(c, pa.int64()) for c in ("token", "cls", "info", "other")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for b in batches:
            for k, x in zip(b.column("bucket").to_pylist(), b.column("data").to_pylist(), strict=True):
                held.setdefault(k, []).append(x)
        pairs: list[np.ndarray] = []
        for k in sorted(held):
            token, cls, info = np.concatenate([_unpack(x) for x in held.pop(k)], axis=1)
            order = np.lexsort((cls, token))
            token, cls, info = token[order], cls[order], info[order]
            once = np.concatenate(([True], (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])))
            token, cls, info = token[once], cls[once], info[once]
            at = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            size = np.diff(np.append(at, len(token)))
            keep = np.repeat(size > 1, size)
            if not keep.any():
                continue
            token, cls, info = token[keep], cls[keep], info[keep]
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(cls), pa.array(info), pa.nulls(len(token), pa.int64())], schema=schema)
            n, pos, matches = _parts(info)
            group = np.cumsum(np.concatenate(([True], token[1:] != token[:-1]))) - 1
            # leaders have the fewest rarer shingles before the shared one: what near copies
            # are copies of, rather than one of its changed forms
            by = np.lexsort((cls, (pos << 20) // n, group))
            edge = np.flatnonzero(np.concatenate(([True], group[by][1:] != group[by][:-1])))
            size = np.diff(np.append(edge, len(by)))
            for k in range(LEADERS):
                lead = by[edge + np.minimum(k, size - 1)][group]
                fits = (cls[lead] != cls) & may_link(n, pos, matches, n[lead], pos[lead], matches[lead], num, den)
                if fits.any():
                    x, y = cls[lead][fits], cls[fits]
                    pairs.append(np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1), axis=0))
        if pairs:
            p = np.unique(np.concatenate(pairs), axis=0)
            for i in range(0, len(p), 100_000):
                x = p[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(x), pa.int64()), pa.array(x[:, 0].copy()), pa.nulls(len(x), pa.int64()), pa.array(x[:, 1].copy())], schema=schema)

    return run


def _cross(num: int, den: int):
    """Rows (a, b, need, hits): pairs of a list's members in different components, with the
    number of shared shingles that count, summed over this task's lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        token, cls, info, root = (table[c].to_numpy() for c in ("token", "cls", "info", "root"))
        order = np.argsort(token, kind="stable")
        token, cls, root = token[order], cls[order], root[order]
        n, pos, matches = _parts(info[order])
        edges = np.append(np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))), len(token))
        out: list[np.ndarray] = []
        waiting = 0
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a < 2 or (root[a:b] == root[a]).all():
                continue
            roots, own, size = np.unique(root[a:b], return_inverse=True, return_counts=True)
            rest = own != np.argmax(size)
            every = np.arange(a, b)
            for i in (np.flatnonzero(rest) + a).tolist():
                # partners: all of the largest component, and of others those not yet met
                j = every[(root[a:b] != root[i]) & (~rest | (every > i))]
                j = j[may_link(n[i], pos[i], matches[i], n[j], pos[j], matches[j], num, den)]
                if len(j):
                    out.append(np.stack((np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j]), np.minimum(matches[i], matches[j])), axis=1))
                    waiting += len(j)
                if waiting > 1_000_000:
                    yield _counted(out)
                    out, waiting = [], 0
        if out:
            yield _counted(out)

    return run


def _counted(out: list[np.ndarray]) -> pa.RecordBatch:
    pairs, hits = np.unique(np.concatenate(out), axis=0, return_counts=True)
    return pa.RecordBatch.from_pydict({"a": pa.array(pairs[:, 0].copy()), "b": pa.array(pairs[:, 1].copy()), "need": pa.array(pairs[:, 2].copy()), "hits": pa.array(hits.astype(np.int64))})


def _places(cls: np.ndarray) -> np.ndarray:
    return (mix(cls.view(U64)) >> U64(64 - FILTER_BITS)).astype(np.int64)


def _class_filter(wanted: DataFrame) -> bytes:
    """A bit per hashed class, of one size whatever the data; set bits of all wanted classes."""
    chunk_bytes = 1 << (CHUNK_BITS + 1)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for b in batches:
            at = _places(b.column("cls").to_numpy())
            np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        parts = {i: x for i, x in enumerate(bits.reshape(-1, chunk_bytes)) if x.any()}
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(parts), pa.int32()), "data": pa.array([zstandard.compress(x.tobytes(), 1) for x in parts.values()], pa.binary())})

    def both(key, batches):
        total = np.zeros(chunk_bytes, np.uint8)
        for x in batches["data"]:
            total |= np.frombuffer(zstandard.decompress(x.as_py()), np.uint8)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())})

    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in wanted.mapInArrow(part, "chunk int, data binary").groupBy("chunk").applyInArrow(both, "chunk int, data binary").collect():  # 16 rows of a fixed size
        out[r["chunk"] * chunk_bytes : (r["chunk"] + 1) * chunk_bytes] = np.frombuffer(zstandard.decompress(bytes(r["data"])), np.uint8)
    return zstandard.compress(out.tobytes(), 1)


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, z): the words of one document of each wanted class, compressed.

    A filter keeps most other classes from being packed; the join decides.
    """
    kept = docs.sparkSession.sparkContext.broadcast(_class_filter(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.frombuffer(zstandard.decompress(kept.value), np.uint8), set()
        squeeze = zstandard.ZstdCompressor(level=3)
        for b in slices(batches, "text"):
            w = words_of(binary(b.column("text")), lower=True)
            cls, z = [], []
            for a, c in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                if a == c:
                    continue
                own = w.data[w.starts[a] : w.ends[c - 1]]
                key = np.array([xxhash.xxh3_64_intdigest(own)], dtype=U64).view(np.int64)
                at = int(_places(key)[0])
                if bits[at >> 3] >> (at & 7) & 1 and int(key[0]) not in seen:
                    seen.add(int(key[0]))
                    cls.append(int(key[0]))
                    z.append(squeeze.compress(own))
            if cls:
                yield pa.RecordBatch.from_pydict({"cls": pa.array(cls, pa.int64()), "z": pa.array(z, pa.binary())})

    found = docs.select("text").mapInArrow(run, "cls long, z binary").join(wanted, "cls", "left_semi")
    return stored(found.dropDuplicates(["cls"]), "texts")


def _verify(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link, checked on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}

        def of(key: int, z: bytes) -> np.ndarray:
            if key not in sets:
                if len(sets) >= 4000:
                    sets.clear()
                sets[key] = next(_shingles(words_of([zstandard.decompress(z)]), size))[1]
            return sets[key]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = []
            for i, (p, q) in enumerate(zip(a, b, strict=True)):
                x, y = of(p, batch.column("za")[i].as_py()), of(q, batch.column("zb")[i].as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both * den >= num * (len(x) + len(y) - both):
                    keep.append(i)
            if keep:
                yield pa.RecordBatch.from_pydict({"a": pa.array([a[i] for i in keep], pa.int64()), "b": pa.array([b[i] for i in keep], pa.int64())})

    met = pairs.join(texts.toDF("a", "za"), "a").join(texts.toDF("b", "zb"), "b")
    return met.select("a", "b", "za", "zb").mapInArrow(run, "a long, b long")


def _met(own: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, cls, n) of every row, and the lists (_LIST) in which classes meet."""
    spark = own.sparkSession
    profile = stored(own.mapInArrow(_profile(size), "doc_id long, cls long, n long, chunk int, data binary"), "profile")
    rows = profile.filter("chunk is null").select("doc_id", "cls", "n")

    chunks = profile.filter("chunk is not null").select("chunk", "data").groupBy("chunk").applyInArrow(_sum_chunks, "chunk int, data binary, total long").collect()
    level = np.zeros(1 << SLOT_BITS, dtype=np.uint8)
    for r in chunks:  # 16 rows of a fixed size
        level[r["chunk"] << CHUNK_BITS : (r["chunk"] + 1) << CHUNK_BITS] = np.frombuffer(zstandard.decompress(bytes(r["data"])), dtype=np.uint8)
    common = 2.0 * sum(r["total"] for r in chunks) / (1 << SLOT_BITS)
    level_data = spark.sparkContext.broadcast(zstandard.compress(level.tobytes()))

    packed = own.select("text").mapInArrow(_prefix_rows(size, num, den, 4 * shuffle_partitions(spark), level_data, common), "bucket int, data binary")
    lists = stored(packed.repartition("bucket").mapInArrow(_lists(num, den), _LIST), "lists")
    return rows, lists


def _candidates(placed: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of list members with different roots that share enough prefix shingles."""
    crossing = placed.repartition("token").mapInArrow(_cross(num, den), "a long, b long, need long, hits long")
    return crossing.groupBy("a", "b", "need").agg(F.sum("hits").alias("hits")).filter("hits >= need").select("a", "b")


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    component_id is the smallest id reachable by links, the row's own included.  Null, empty
    and white-space texts have 0 shingles and are alone.  Rows with a null id take part; their
    component_id is the smallest non-null id they reach, else null.  Repeated rows are copies
    of one another.  Empty input gives no rows.
    """
    num, den = percent, 100
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows, lists = _met(own, size, num, den)
    members = lists.filter("other is null").select("token", "cls", "info")
    first = lists.filter("other is not null").select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")).distinct()
    first = stored(first, "pairs")
    texts = _texts_of(own, stored(members.select("cls").distinct(), "met"))
    links = _verify(first, texts, size, num, den)
    classes = stored(rows.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "classes")
    roots = stored(connected_components(_named(links, classes)), "roots")

    of = roots.select(F.col("node.cls").alias("cls"), F.col("root.cls").alias("root"))
    placed = members.join(of, "cls", "left").select("token", "cls", "info", F.coalesce("root", "cls").alias("root"))
    second = _candidates(placed, num, den).join(first, ["a", "b"], "left_anti")
    more = stored(_verify(second, texts, size, num, den), "links")
    if not more.isEmpty():
        # links between components: the old stars and the new links together
        roots = stored(connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(_named(more, classes))), "roots")

    # a root is named by its smallest id, so nothing has to be looked up by component
    reached = roots.select(F.col("node.cls").alias("cls"), F.when(~F.col("root.unnamed"), F.col("root.least")).alias("reached"), F.lit(True).alias("linked"))
    component = F.when(F.col("linked"), F.col("reached")).otherwise(F.col("least")).alias("component_id")
    named = classes.join(reached, "cls", "left").select(F.col("cls").alias("named"), component, "copies")
    # a text with more than a thousandth of all rows, so one of under a thousand, is dealt to many tasks
    total, most = classes.agg(F.sum("copies"), F.max("copies")).first()
    limit = max(HOT_ROWS, (total or 0) // 1000)
    if (most or 0) > limit:
        often = F.col("copies") > limit
        salts = F.when(often, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        named = named.select("named", "component_id", F.explode(salts).alias("of_salt"))
        hot = F.broadcast(classes.filter(often).select(F.col("cls").alias("hot")))
        salt = F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(SALTS)).cast("int")).otherwise(0)
        dealt = rows.join(hot, F.col("cls") == F.col("hot"), "left").withColumn("salt", salt)
        met = dealt.join(named, (F.col("cls") == F.col("named")) & (F.col("salt") == F.col("of_salt")), "left")
    else:
        met = rows.join(named, F.col("cls") == F.col("named"), "left")
    return met.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _named(links: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) of classes as links of nodes (unnamed, least, cls): the smallest node of a
    component has the smallest id in it, where any of its rows has one."""
    node = F.struct(F.col("least").isNull().alias("unnamed"), F.coalesce("least", F.lit(0)).alias("least"), F.col("cls").alias("cls"))
    names = classes.select("cls", node.alias("node"))
    met = links.join(names.toDF("a", "x"), "a").join(names.toDF("b", "y"), "b")
    return met.select(F.col("x").alias("a"), F.col("y").alias("b"))


def jaccard_link_counts(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, n_links) for every row of ``docs``: the number of other rows that it
    links to, copies included.

    Every pair of classes with enough shared prefix shingles is verified.  Null, empty and
    white-space texts link to nothing.  Rows count, not ids.
    """
    num, den = percent, 100
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows, lists = _met(own, size, num, den)
    members = lists.filter("other is null").select("token", "cls", "info")
    pairs = stored(_candidates(members.withColumn("root", F.col("cls")), num, den), "pairs")
    texts = _texts_of(own, stored(members.select("cls").distinct(), "met"))
    links = stored(_verify(pairs, texts, size, num, den), "links")
    copies = rows.filter("n > 0").groupBy("cls").agg(F.count("*").alias("copies"))
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(copies.toDF("b", "other"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("other").alias("others"))
    counts = copies.join(others, "cls", "left").select("cls", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    met = rows.join(counts.toDF("counted", "links"), (F.col("cls") == F.col("counted")) & (F.col("n") > 0), "left")
    return met.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("links", F.lit(0)).alias("n_links"))
