"""Approximate nearest neighbours by inner product, with score-aware quantisation.

Vectors are dealt to inverted lists by a coarse quantiser.  The residual is coded in subspaces of
two components with 16 codewords, four bits each.  Codes and codebooks minimise the
anisotropic loss: the error parallel to the vector, which changes large inner products, counts
``eta`` times as much as the error across it.  A query scans the codes of its nearest lists with
one table of 16 partial products a subspace.  The length of each row's coding error is stored: it
bounds how far the estimate is from the inner product, and every row of a block that the bound leaves
among the best is ranked again by its exact inner product, however many these are.

The quantisers are fitted on a bounded sample (SAMPLE vectors by a hash of the id, LISTS lists at
most), and the number of lists to probe is the least with which queries from the sample find a share
AIM of their true neighbours in it; every vector is indexed.  Lists are split into blocks of about BLOCK rows, so that no
task holds a whole large list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motifloom.llm._shared import stored

SAMPLE = 20_000
LISTS = 1024
BLOCK = 4096
LIST_ROWS = 2048
AIM = 0.97


@dataclass
class Quantiser:
    dim: int
    centroids: np.ndarray  # lists x dim
    books: np.ndarray  # subspaces x 16 x 2
    eta: float

    def lists(self, x: np.ndarray) -> np.ndarray:
        return np.argmin((self.centroids**2).sum(axis=1) - 2 * x @ self.centroids.T, axis=1)

    def padded(self, x: np.ndarray) -> np.ndarray:
        short = 2 * len(self.books) - x.shape[1]
        return np.pad(x, ((0, 0), (0, short))) if short else x

    def encode(self, x: np.ndarray, lists: np.ndarray, sweeps: int = 2) -> np.ndarray:
        r, unit = self.padded(x - self.centroids[lists]), self.padded(x / np.linalg.norm(x, axis=1, keepdims=True))
        return _codes(r, unit, self.books, self.eta, None, sweeps)

    def errors(self, x: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Lengths of the coding errors, with room for rounding: an inner product with q differs from
        its estimate by |q| times this at most."""
        near, coded = self.centroids[lists], self.books[np.arange(len(self.books)), codes].reshape(len(x), -1)
        size = lambda v: np.linalg.norm(v, axis=1)
        return size(self.padded(x - near) - coded) + 1e-11 * (size(x) + size(near) + size(coded))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """queries x subspaces x 16: inner products with every codeword."""
        return np.einsum("qmd,mcd->qmc", self.padded(q).reshape(len(q), len(self.books), 2), self.books)


def _codes(r: np.ndarray, unit: np.ndarray, books: np.ndarray, eta: float, codes: np.ndarray | None, sweeps: int) -> np.ndarray:
    """Codes by coordinate descent on |e|^2 + (eta - 1) <e, unit>^2, e the error of the residual."""
    n, m = len(r), len(books)
    r, unit = r.reshape(n, m, 2), unit.reshape(n, m, 2)
    if codes is None:
        codes = np.stack([np.argmin(((r[:, j, None] - books[j]) ** 2).sum(axis=2), axis=1) for j in range(m)], axis=1)
    along = np.einsum("nmd,nmd->nm", r - books[np.arange(m), codes], unit)
    total = along.sum(axis=1)
    for _ in range(sweeps):
        for j in range(m):
            error = r[:, j, None] - books[j]  # n x 16 x 2
            part = np.einsum("ncd,nd->nc", error, unit[:, j])
            rest = total - along[:, j]
            codes[:, j] = np.argmin((error**2).sum(axis=2) + (eta - 1) * (rest[:, None] + part) ** 2, axis=1)
            along[:, j] = part[np.arange(n), codes[:, j]]
            total = rest + along[:, j]
    return codes


def fit(x: np.ndarray, lists: int, threshold: float = 0.2, rounds: int = 8, seed: int = 3) -> Quantiser:
    """Coarse k-means and anisotropic codebooks of a sample; eta follows from the share
    ``threshold`` of the norm over which inner products matter."""
    n, dim = x.shape
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, n))
    q = Quantiser(dim, x[rng.choice(n, lists, replace=False)].copy(), np.zeros((-(-dim // 2), 16, 2)), max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2)))
    for _ in range(rounds):
        own = q.lists(x)
        count = np.bincount(own, minlength=lists)
        total = np.zeros_like(q.centroids)
        np.add.at(total, own, x)
        q.centroids = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[rng.choice(n, lists)])
    own = q.lists(x)
    r, unit = q.padded(x - q.centroids[own]), q.padded(x / np.linalg.norm(x, axis=1, keepdims=True))
    m = len(q.books)
    parts, across = r.reshape(n, m, 2), unit.reshape(n, m, 2)
    q.books = np.stack([parts[rng.choice(n, 16), j] for j in range(m)])
    codes = None
    for _ in range(rounds):
        codes = _codes(r, unit, q.books, q.eta, codes, 1)
        error = parts - q.books[np.arange(m), codes]
        along = np.einsum("nmd,nmd->nm", error, across)
        total = along.sum(axis=1)
        for j in range(m):
            u, rest = across[:, j], total - along[:, j]
            want = parts[:, j] + (q.eta - 1) * u * (rest + (parts[:, j] * u).sum(axis=1))[:, None]
            for c in range(16):
                mine = codes[:, j] == c
                if mine.any():
                    q.books[j, c] = np.linalg.solve(mine.sum() * np.eye(2) + (q.eta - 1) * u[mine].T @ u[mine], want[mine].sum(axis=0))
            along[:, j] = ((parts[:, j] - q.books[j][codes[:, j]]) * u).sum(axis=1)
            total = rest + along[:, j]
    return q


def probes_needed(q: Quantiser, x: np.ndarray, k: int, aim: float = AIM, queries: int = 400) -> int:
    """Lists a query must probe to find ``aim`` of its k nearest, measured on the sample."""
    asks = np.arange(0, len(x), max(1, len(x) // queries))
    near = np.argsort(-(x[asks] @ q.centroids.T), axis=1, kind="stable")
    place = np.empty_like(near)
    np.put_along_axis(place, near, np.broadcast_to(np.arange(near.shape[1]), near.shape), axis=1)
    own, met = q.lists(x), np.zeros(len(q.centroids), dtype=np.int64)
    for i, row in zip(asks.tolist(), place, strict=True):
        score = x @ x[i]
        score[i] = -np.inf
        best = np.argsort(-score, kind="stable")[: min(k, len(x) - 1)]
        met += np.bincount(row[own[best]], minlength=len(met))
    found = np.cumsum(met)
    return int(np.searchsorted(found, aim * found[-1])) + 1 if found[-1] else len(met)


def kth_score(x: np.ndarray, ids: np.ndarray, known: np.ndarray, known_ids: np.ndarray, k: int) -> np.ndarray:
    """For each query a score that k known candidates reach: no row below it can be among the k nearest."""
    score = x @ known.T
    score[ids[:, None] == known_ids] = -np.inf
    if score.shape[1] < k:
        return np.full(len(x), -np.inf)
    return np.partition(score, -k, axis=1)[:, -k] - 1e-9


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vector: Column, dim: int | None = None) -> Column:
    """Neither null nor zero, all components present and finite, and of the right length."""
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    whole = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, good) & F.exists(vector, lambda v: v != 0)
    return F.coalesce(whole & (F.size(vector) == dim) if dim else whole, F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, probes: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``is_query`` the k rows found with the largest
    inner products (double precision), nearest first, ties by the smaller id.

    Rows with a null id, and vectors that are null, empty, zero or hold null or non-finite
    components, take no part; nor do those that differ in length from most of the sample.
    Rows that share a query's id are its own row; repeated rows of another id are candidates
    each.  A query whose ``probes`` lists hold fewer than k candidates probes more, so all its
    ranks are filled; fewer candidates than k in all are all returned.  Without usable rows
    the result is empty.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    total = rows.count()
    rank = F.xxhash64("vec_id", F.lit(1))
    bound = min(2**63 - 1, int(-(2**63) + min(1.0, 1.2 * SAMPLE / max(1, total)) * 2**64))
    sample = rows.filter(rank <= F.lit(bound)).orderBy(rank).limit(SAMPLE).select("vec_id", "v").collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sample:
        return empty
    sizes = np.bincount([len(r["v"]) for r in sample])
    dim = int(np.argmax(sizes))
    rows = rows.filter(F.size("v") == dim)
    sample = [r for r in sample if len(r["v"]) == dim]
    known, known_ids = np.array([r["v"] for r in sample]), np.array([r["vec_id"] for r in sample])
    model = fit(known, min(LISTS, max(1, total // LIST_ROWS)))
    shared = spark.sparkContext.broadcast(model)
    seen = spark.sparkContext.broadcast((known, known_ids))  # SAMPLE vectors at most
    lists = len(model.centroids)
    probes = min(lists, probes or probes_needed(model, known, k))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"), dim)
                own = shared.value.lists(x)
                codes = shared.value.encode(x, own)
                err, codes = shared.value.errors(x, own, codes), codes.astype(np.uint8)
                if codes.shape[1] % 2:
                    codes = np.pad(codes, ((0, 0), (0, 1)))
                packed = codes[:, ::2] | (codes[:, 1::2] << 4)
                yield pa.RecordBatch.from_pydict({"list": pa.array(own, pa.int32()), "vec_id": b.column("vec_id"), "codes": pa.array([c.tobytes() for c in packed], pa.binary()), "err": pa.array(err), "v": b.column("v"), "q": b.column("q")})

    table = stored(rows.mapInArrow(index, "list int, vec_id long, codes binary, err double, v array<double>, q boolean"), "index")
    counts = {r["list"]: r["n"] for r in table.groupBy("list").agg(F.count("*").alias("n")).collect()}  # LISTS numbers at most
    blocks = np.array([-(-counts.get(i, 0) // BLOCK) for i in range(lists)])
    block_of = F.pmod(F.xxhash64("vec_id", "codes"), F.element_at(F.lit([max(1, int(b)) for b in blocks]), F.col("list") + 1)).cast("int")

    # by list and n = 1..k: rows that its blocks give if each gives n at most
    held = table.groupBy("list", block_of.alias("block")).agg(F.count("*").alias("n"))
    gives = np.zeros((lists, k))
    for r in held.select("list", *(F.least("n", F.lit(i + 1)).alias(f"n{i}") for i in range(k))).groupBy("list").agg(*(F.sum(f"n{i}") for i in range(k))).collect():
        gives[r[0]] = r[1:]
    rows_of = np.array([counts.get(i, 0) for i in range(lists)])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, ids = _matrix(b.column("v"), dim), b.column("vec_id").to_numpy()
            near = x @ shared.value.centroids.T
            chosen, own = np.argsort(-near, axis=1, kind="stable"), b.column("own").to_numpy()
            # lists until k rows of other ids are met, whatever share of the lists' rows has the query's id
            reach = np.maximum(probes, 1 + (np.cumsum(rows_of[chosen], axis=1) < (k + own)[:, None]).sum(axis=1))
            taken = np.arange(lists) < reach[:, None]
            # twice k known candidates: enough are left where the scan misses some
            least = np.concatenate([kth_score(x[a : a + 256], ids[a : a + 256], *seen.value, 2 * k) for a in range(0, len(x), 256)])
            # and each part gives a few in any case, so that every query fills its ranks
            probed = np.zeros((len(x), lists))
            np.put_along_axis(probed, chosen, taken, axis=1)
            few = np.minimum(k, 1 + (probed @ gives < (2 * k + own)[:, None]).sum(axis=1)).astype(np.int32)
            i, j = np.nonzero(taken)[0], chosen[taken]
            n = blocks[j]
            i, j = np.repeat(i, n), np.repeat(j, n)
            part = np.arange(len(j)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_pydict({"list": pa.array(j, pa.int32()), "block": pa.array(part, pa.int32()), "query_id": b.column("vec_id").take(pa.array(i)), "v": b.column("v").take(pa.array(i)), "least": pa.array(least[i]), "few": pa.array(few[i])})

    shares = table.groupBy("vec_id").agg(F.count("*").alias("own"))
    asked = table.filter("q").select("vec_id", "v").join(shares, "vec_id").select("vec_id", "v", "own").mapInArrow(probe, "list int, block int, query_id long, v array<double>, least double, few int")

    def scan(rows_here, queries):
        out = [], [], []
        if rows_here.num_rows and queries.num_rows:
            q = shared.value
            ids = rows_here["vec_id"].to_numpy()
            x = _matrix(rows_here["v"].combine_chunks(), dim)
            packed = np.frombuffer(b"".join(rows_here["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)
            codes = np.empty((len(ids), 2 * packed.shape[1]), np.int64)
            codes[:, ::2], codes[:, 1::2] = packed & 15, packed >> 4
            m = len(q.books)
            flat = np.ascontiguousarray((codes[:, :m] + 16 * np.arange(m)).T)
            asks, qid, least = _matrix(queries["v"].combine_chunks(), dim), queries["query_id"].to_numpy(), queries["least"].to_numpy()
            few = queries["few"].to_numpy()
            tables = q.tables(asks).reshape(len(asks), -1)
            base, size = asks @ q.centroids[rows_here["list"][0].as_py()], np.linalg.norm(asks, axis=1)
            err = rows_here["err"].to_numpy()
            for n in range(len(asks)):
                rough = tables[n][flat[0]] + base[n]
                for j in range(1, m):
                    rough += tables[n][flat[j]]
                rough[ids == qid[n]] = -np.inf
                best = _within(rough, size[n] * err, k, few[n], least[n])
                best = best[ids[best] != qid[n]]
                # a copy of most of the block costs more than products with all of it
                score = (x * asks[n]).sum(axis=1)[best] if 2 * len(best) > len(ids) else (x[best] * asks[n]).sum(axis=1)
                keep = np.lexsort((ids[best], -score))[:k]
                keep = keep[(score[keep] >= least[n]) | (np.arange(len(keep)) < few[n])]
                out[0].append(np.full(len(keep), qid[n]))
                out[1].append(ids[best[keep]])
                out[2].append(score[keep])
        columns = [np.concatenate(c) if c else np.empty(0) for c in out]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    listed = table.select("list", block_of.alias("block"), "vec_id", "codes", "err", "v")
    found = listed.groupBy("list", "block").cogroup(asked.groupBy("list", "block")).applyInArrow(scan, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _within(rough: np.ndarray, slack: np.ndarray, k: int, few: int, least: float) -> np.ndarray:
    """All rows that can be among the k best and reach ``least``, or among the ``few`` best, where the
    true values are within ``slack`` of ``rough``."""
    low = np.sort(rough - slack) if len(rough) <= k else np.sort(np.partition(rough - slack, len(rough) - k)[-k:])
    best = lambda n: low[-n] if n <= len(low) else -np.inf
    return np.flatnonzero(rough + slack >= min(best(min(few, k)), max(best(k), least)))
