"""Memory of the word scan: it follows the chunk, not the batch."""

import tracemalloc

import numpy as np
import pyarrow as pa

from juryframe.llm import words as W


def test_scan_of_a_batch_stays_small(monkeypatch):
    monkeypatch.setattr(W, "_BYTES", W._Powers(W._STEP))
    texts = pa.array([f"row {i} " + "some words of a text " * 50 for i in range(4000)]).cast(pa.binary())
    whole = np.concatenate([W.scan(d, b, W.SPACED).hash for _, _, d, b in W.chunks(texts, 1 << 20)])
    monkeypatch.setattr(W, "_BYTES", W._Powers(W._STEP))
    tracemalloc.start()
    parts = [W.scan(d, b, W.SPACED).hash for _, _, d, b in W.chunks(texts)]
    peak = tracemalloc.get_traced_memory()[1] - sum(p.nbytes for p in parts)
    tracemalloc.stop()
    assert np.array_equal(np.concatenate(parts), whole)
    assert peak < 20 << 20
