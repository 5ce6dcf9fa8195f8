"""Word arrays: whole texts as numpy arrays of word positions and 64-bit hashes.

Words are ``[^\x20\x09-\x0D]+`` of the UTF-8 bytes; ``bytes.split()`` cuts at exactly
these six bytes and ``bytes.lower()`` changes A-Z only.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SEGMENT = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_BASE, _SEGMENT + 1)
_INV = _powers(pow(_BASE, -1, 1 << 64), _SEGMENT + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for ascending spans that don't overlap, in time linear in the bytes."""
    out = np.empty(len(starts), dtype=U64)
    i, n = 0, len(starts)
    while i < n:
        base = int(starts[i])
        j = int(np.searchsorted(ends, base + _SEGMENT, side="right"))
        if j <= i:  # one span longer than a segment: block by block
            total, shift = 0, 1
            for at in range(base, int(ends[i]), _SEGMENT):
                block = data[at : min(at + _SEGMENT, int(ends[i]))].astype(U64) + U64(1)
                total = (total + int((block * _POW[: len(block)]).sum()) * shift) % (1 << 64)
                shift = shift * pow(_BASE, _SEGMENT, 1 << 64) % (1 << 64)
            out[i] = total
            i += 1
            continue
        block = data[base : int(ends[j - 1])].astype(U64)
        block += U64(1)
        block *= _POW[: len(block)]
        sums = np.zeros(len(block) + 1, dtype=U64)
        np.cumsum(block, out=sums[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[b] - sums[a]) * _INV[a]
        i = j
    return mix(out)


def runs_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values: out[i] covers h[i:i+k]; length len(h)-k+1 or 0."""
    if len(h) < k:
        return np.empty(0, dtype=U64)
    c = 0xD6E8FEB86659FD93 | 1
    done, acc, step, part = 0, None, 1, h
    while True:  # the bits of k from the lowest: `part` covers `step` values
        if k & step:
            if acc is None:
                acc, done = part, step
            else:
                m = min(len(acc), len(part) - done)
                acc = acc[:m] + part[done : done + m] * U64(pow(c, done, 1 << 64))
                done += step
            if done == k:
                return mix(acc[: len(h) - k + 1])
        m = len(part) - step
        if m <= 0:
            part = part[:0]
        else:
            part = part[:m] + part[step:] * U64(pow(c, step, 1 << 64))
        step *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """out[i] = min(x[i:i+w]); length len(x)-w+1."""
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < w:
        out = np.minimum(out[: len(x) - w + 1], out[w - have : w - have + len(x) - w + 1])
    return out


@dataclass
class Words:
    """The words of some texts: ``data`` holds them with one space after each."""

    data: bytes
    array: np.ndarray
    starts: np.ndarray  # of each word in data
    ends: np.ndarray
    first: np.ndarray  # index of each text's first word; one more entry at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.array, self.starts, self.ends)


def words_of(texts: Iterable[bytes | None], lower: bool = False) -> Words:
    parts, counts = [], []
    for t in texts:
        w = (t.lower() if lower else t).split() if t else ()
        counts.append(len(w))
        if w:
            parts.append(b" ".join(w))
    data = b" ".join(parts) + b" " if parts else b""
    array = np.frombuffer(data, dtype=np.uint8)
    ends = np.flatnonzero(array == 32)
    starts = np.empty_like(ends)
    if len(ends):
        starts[0] = 0
        starts[1:] = ends[:-1] + 1
    return Words(data, array, starts, ends, np.concatenate(([0], np.cumsum(counts, dtype=np.int64))).astype(np.int64))


def binary(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def release() -> None:
    """Give freed memory back to the system: workers are used again by later tasks, and an executor
    holds several of them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_held: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """The one large thing that this worker keeps from task to task, such as a cache; made anew
    when another is asked for."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def slices(batches: Iterable[pa.RecordBatch], column: str, size: int = 1 << 21, holding: bool = False) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches of about ``size`` bytes of ``column``; frees memory at the end.

    Unless ``holding``, the worker first lets go of what an earlier operator held.
    """
    if _held and not holding:
        _held.clear()
        release()
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = batch.column(column)
        if not pa.types.is_integer(lengths.type):
            lengths = pc.binary_length(lengths)
        total = np.cumsum(np.nan_to_num(lengths.to_numpy(zero_copy_only=False).astype(float)) + 16)
        at = 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, before + size, side="right")))
            yield batch.slice(at, to - at)
            at = to
    release()
