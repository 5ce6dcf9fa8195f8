import numpy as np
import pyarrow as pa

from motifloom.llm import _text
from motifloom.llm._text import runs_hash, slices, sliding_min, span_hashes, words_of


def test_equal_words_have_equal_hashes_and_others_do_not():
    w = words_of([b"b a  b\t\xc3\xa9", None, b"", b"a" * 700_000 + b" b " + b"a" * 700_000, b"\xc2\xa0"])
    h = w.hashes()
    assert w.counts.tolist() == [4, 0, 0, 3, 1]
    assert h[0] == h[2] == h[5] and h[4] == h[6] and len(set(h.tolist())) == 5


def test_long_and_short_spans_agree():
    data = np.frombuffer(bytes(range(256)) * 4000, np.uint8)
    whole = span_hashes(data, np.array([5]), np.array([600_005]))
    again = span_hashes(data[256:], np.array([5]), np.array([600_005]))
    assert whole[0] == again[0] != span_hashes(data, np.array([6]), np.array([600_006]))[0]


def test_windows():
    x = np.random.default_rng(1).integers(0, 2**63, 90).astype(np.uint64)
    for k in (1, 2, 5, 19, 20, 90):
        assert runs_hash(np.concatenate((x[7:], x))[: 83 + k], k)[83] == runs_hash(x, k)[0]
        assert (sliding_min(x, k) == [x[i : i + k].min() for i in range(91 - k)]).all()
    assert len(runs_hash(x[:4], 5)) == 0


def test_slices_keep_all_rows():
    b = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (1, 900, 5, 5, 2000, 1)] + [None]})
    parts = list(slices([b], "text", 1000))
    assert sum(p.num_rows for p in parts) == 7 and len(parts) > 2
    assert _text.words_of([]).counts.tolist() == []
