"""Quality scores by Bradley-Terry pairwise ranking.

Each text has a fixed vector of surface statistics over the whole text.  From labelled rows,
pairs of a preferred and a rejected text are drawn; the logistic loss on the differences of
their vectors gives one weight a feature, and a text's rank score is the weighted sum.  A
quantile of the training scores is the threshold; scores are shown on a 0 to 1 scale on which
that threshold is ``cut``.

Learning uses a bounded sample, ``sample_rows`` labelled rows taken evenly by a hash of the id;
the scoring covers every row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifloom.llm._text import binary, slices

SAMPLE_ROWS = 12_000
PAIRS = 60_000

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9), "line": (10,), "high": range(128, 256),
    "stop": b".?", "comma": b",;:", "bang": b"!", "hash": b"#", "percent": b"%", "amp": b"&", "star": b"*", "dollar": b"$", "bar": b"|",
    "brackets": b"<>[]{}()", "quotes": b"\"'`", "slash": b"/\\=+-_~^@",
}
_MEMBER = np.zeros((len(_CLASSES), 256))
for _i, _bytes in enumerate(_CLASSES.values()):
    _MEMBER[_i, list(_bytes)] = 1
FEATURES = [*_CLASSES, *(f"root_{c}" for c in _CLASSES), "log_words", "word_length", "long_word", "distinct", "top_word", "line_words", "repeated_lines", "distinct_pairs", "empty"]


def features(text: bytes | None) -> np.ndarray:
    """The statistics of one whole text; those of a null text are those of an empty one."""
    text = text or b""
    words = text.split()
    shares = _MEMBER @ np.bincount(np.frombuffer(text, np.uint8), minlength=256) / max(1, len(text))
    n = len(words)
    seen = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    more = (
        np.log1p(n), min(30.0, sum(map(len, words)) / max(1, n)), min(100, max(map(len, words), default=0)) / 10,
        len(seen) / max(1, n), max(seen.values(), default=0) / max(1, n), np.log1p(n / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)), pairs / max(1, n - 1), float(n == 0),
    )
    return np.concatenate((shares, np.sqrt(shares), more))


def _scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Deviations, at most 8: learnt and scored alike, so extreme texts are not extrapolated."""
    return np.clip((x - mean) / scale, -8, 8)


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float
    cut: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = _scaled(x, self.mean, self.scale) @ self.weight - self.threshold + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def bradley_terry(x: np.ndarray, y: np.ndarray, cut: float = 0.3, pairs: int = PAIRS, penalty: float = 2e-3, seed: int = 5) -> Ranker:
    """Weights from ``pairs`` random (preferred, rejected) pairs of the bounded sample by Newton steps; the threshold is the
    training-score quantile that makes the fewest errors (the middle of equally good ones).
    Without both labels nothing can be ranked: all weights are 0 and every score is over ``cut``."""
    mean, scale = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    scale = np.where(scale > 1e-9, scale, 1.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    weight = np.zeros(len(mean))
    if not len(good) or not len(bad):
        return Ranker(mean, scale, weight, -1.0, cut)
    rng = np.random.default_rng(seed)
    z = _scaled(x, mean, scale)
    diff = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(diff @ weight, -30, 30)))  # chance of the wrong order
        slope = penalty * weight - diff.T @ p / pairs
        curve = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + penalty * np.eye(len(weight))
        step = np.linalg.solve(curve, slope)
        weight = weight - step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ weight
    order = np.argsort(raw, kind="stable")
    errors = np.concatenate(([0], np.cumsum(y[order] == 1))) + np.concatenate((np.cumsum((y[order] == 0)[::-1])[::-1], [0]))
    best = np.flatnonzero(errors == errors.min())
    quantile = best[len(best) // 2] / len(raw)
    return Ranker(mean, scale, weight, float(np.quantile(raw, quantile)), cut)


def _with_features(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``x``, the vector of ``__text``."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text", 1 << 22):
            x = [features(t) for t in binary(b.column("__text"))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select(*keep, "__text").mapInArrow(compute, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "x array<double>"]))


def learn_ranker(docs: DataFrame, labels: DataFrame, train: Column, cut: float = 0.3, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Ranker:
    """Learn from labelled rows (``labels``: id, quality 0 or 1) where ``train``, a condition on
    the id, holds: at most ``sample_rows`` of them, drawn evenly by a hash of the id, and PAIRS
    preference pairs among them.  Other labels, null ids and ids without a document teach nothing."""
    usable = labels.filter(train & F.col("quality").isin(0, 1) & F.col(f"`{id_col}`").isNotNull())
    total = usable.count()
    rank = F.xxhash64(F.col(f"`{id_col}`"), F.lit(11))
    bound = min(2**63 - 1, int(-(2**63) + min(1.0, 1.2 * sample_rows / max(1, total)) * 2**64))
    picked = usable.filter(rank <= F.lit(bound)).select(F.col(f"`{id_col}`").alias("__id"), F.col("quality").cast("int").alias("__y")).orderBy(rank, "__y").limit(sample_rows)
    # at most sample_rows pairs of numbers
    met = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text")).join(F.broadcast(picked), "__id")
    # an id may have many documents
    rows = _with_features(met, ["__id", "__y"]).orderBy(F.xxhash64("__id", "x"), "__id").limit(sample_rows).collect()
    rows.sort(key=lambda r: (r["__id"], r["__y"], r["x"]))
    return bradley_terry(np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r["__y"] for r in rows], dtype=int), cut)


def score_quality(docs: DataFrame, ranker: Ranker, text_col: str = "text") -> DataFrame:
    """``docs`` with ``quality_score`` (0 to 1) and ``quality_pred`` (1 if the score is at least
    the ranker's cut).  Null and empty texts get the score of the empty text; rows are neither
    dropped nor merged; columns of the two names are replaced."""
    docs = docs.drop("quality_score", "quality_pred")
    names = docs.columns
    model = docs.sparkSession.sparkContext.broadcast(ranker)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = model.value
        for b in slices(batches, "__text", 1 << 22):
            s = r.scores(np.stack([features(t) for t in binary(b.column("__text"))]))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(names))), pa.array(s, pa.float64()), pa.array((s >= r.cut).astype(np.int32), pa.int32())],
                names=[*names, "quality_score", "quality_pred"],
            )

    given = docs.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text_col}`").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "quality_score double", "quality_pred int"])
    return given.mapInArrow(score, schema)
