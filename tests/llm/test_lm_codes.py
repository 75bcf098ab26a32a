"""Codes of a language model's n-grams: the bytes of the plain forms, in well under their CPU time."""

import time

import numpy as np
import pytest

from tremolo.llm.elias_fano import EliasFano
from tremolo.llm.lm_scoring import _Block, _pack, _unpack


def plain_code(values: np.ndarray, low_bytes: int) -> tuple[bytes, bytes]:
    """Low bytes and bitmap of sorted numbers."""
    low = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :low_bytes])
    at = (values >> np.uint64(8 * low_bytes)).astype(np.int64) + np.arange(len(values))
    high = np.zeros(int(at[-1]) // 8 + 1, dtype=np.uint8)
    np.bitwise_or.at(high, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return low.tobytes(), high.tobytes()


def plain_numbers(code: EliasFano) -> np.ndarray:
    at = np.flatnonzero(np.unpackbits(code.high, bitorder="little"))[: len(code)] - np.arange(len(code))
    out = np.zeros((len(code), 8), dtype=np.uint8)
    out[:, : code.low_bytes] = code.low.reshape(len(code), code.low_bytes)
    return (at.astype(np.uint64) << np.uint64(8 * code.low_bytes)) | out.view("<u8").ravel()


def least(f, tries: int = 7) -> float:
    took = []
    for _ in range(tries):
        start = time.process_time()
        f()
        took.append(time.process_time() - start)
    return min(took)


@pytest.mark.parametrize("top", [40, 48, 62])
def test_sorted_numbers(top):
    values = np.sort(np.random.default_rng(top).integers(0, 1 << top, 500_000, dtype=np.uint64))
    code = EliasFano.encode(values)
    assert (code.low.tobytes(), code.high.tobytes()) == plain_code(values, code.low_bytes)
    assert (code.decode() == values).all() and (plain_numbers(code) == values).all()
    assert (code.decode(1234, 456_789) == values[1234:456_789]).all()
    assert least(lambda: EliasFano.encode(values)) < 0.7 * least(lambda: plain_code(values, code.low_bytes))
    assert least(code.decode) < 0.8 * least(lambda: plain_numbers(code))


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [0xE7037ED1A0B428DB], [0xFFFFFFFFFFFFFFFF], list(range(1000))])
def test_few_numbers(values):
    values = np.array(values, dtype=np.uint64)
    assert (EliasFano.frombuffer(EliasFano.encode(values).tobytes()).decode() == values).all()


def test_packed_arrays():
    rng = np.random.default_rng(3)
    arrays = [rng.integers(0, 200, 5000).astype(kind) for kind in ("u1", "<u2", "<u4", "<u8", "<f8")] + [np.empty(0, dtype="<u4"), np.arange(20, dtype="<u4")[::3]]
    for a, b in zip(arrays, _unpack(_pack(*arrays))):
        assert a.dtype == b.dtype and (a == b).all()


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("hot", [[], [7]])
def test_pairs_of_a_block(order, hot):
    """Each token's pair is its context and word, and pairs count its training documents."""
    rng = np.random.default_rng(order)
    words = np.sort(rng.integers(0, 1 << 63, 50, dtype=np.uint64))
    lengths, held = [40, 1, 300, 7], [False, False, True, False]
    ids = rng.integers(0, 50, sum(lengths)).astype("<u4")
    x = _Block(held, lengths, _pack(ids, np.arange(50, dtype="<u4")), EliasFano.encode(words).tobytes(), 4, words[hot])
    x.ngrams(order)
    group, owner = x.group(), np.repeat(np.arange(len(x.contexts)), x.sizes)
    assert (x.followers[group] == (words[ids] >> np.uint64(32))).all()
    assert (np.diff(x.contexts.astype(object)) > 0).all() and x.pair_cuts[-1] == len(x.followers)
    train = ~np.repeat(held, lengths)
    seen = {}
    for g, context, word, t in zip(group, x._contexts(order) if not hot or order > 2 else x.contexts[owner[group]], ids, train):
        assert x.contexts[owner[g]] == context
        seen.setdefault((context, word), []).append(t)
    assert len(seen) == len(x.followers) and sorted(map(sum, seen.values())) == sorted(x.seen())
