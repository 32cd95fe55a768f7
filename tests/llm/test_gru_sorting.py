"""Symbols are put in order as numbers of 16 bits, which numpy sorts by digits."""

import numpy as np
import pyarrow as pa

from regmart.llm import gru_lm


def test_windows_are_sorted_by_short_numbers(monkeypatch):
    rng = np.random.default_rng(3)
    n = gru_lm.CLASSES * gru_lm.CLASS_WORDS
    rare = np.full(gru_lm.RARE, 5.0)
    known = gru_lm.Vocabulary(pa.array([str(i) for i in range(n)], pa.large_string()), np.arange(n, 0, -1), 10**6, 2 * n, rare, rare)
    model = gru_lm.Gru.start(known)
    symbols = rng.integers(0, n + gru_lm.RARE, 800).astype(np.int32)
    assert n + gru_lm.RARE <= np.iinfo(np.int16).max
    kinds, plain = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, **how: kinds.append(a.dtype.itemsize) or plain(a, **how))
    inputs = symbols[:400].reshape(20, 20)
    back, _, _ = model.gradients(inputs, np.ones((20, 20), np.float32), symbols[400:].reshape(20, 20), np.zeros((gru_lm.HIDDEN, 20), np.float32))
    assert len(kinds) == 2 and set(kinds) == {2}
    seen = np.zeros(n + gru_lm.RARE, bool)
    seen[inputs] = True
    assert np.array_equal(np.abs(back["inputs"]).sum(axis=0) > 0, seen)
