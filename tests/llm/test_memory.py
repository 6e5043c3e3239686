"""What kernels hold beside their rows."""

import tracemalloc

import numpy as np

from meshwright.llm import jaccard


def test_jaccard_bitmap_is_not_unpacked():
    bitmap = np.random.default_rng(1).integers(0, 256, (1 << jaccard.BITS) // 8).astype(np.uint8).tobytes()
    tracemalloc.start()
    assert list(jaccard._sets(bitmap)(iter([]))) == []
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1 << 20  # 32 MB before
    bits = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little")
    for c in np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 1000).tolist():
        assert jaccard.marked(bitmap, c) == bits[(c & (1 << 64) - 1) >> (64 - jaccard.BITS)]


def test_jaccard_keys_met_often_are_held_twice_at_most():
    every = np.random.default_rng(3).integers(0, 300_000, 1_000_000).astype(np.uint64)
    k, n = np.unique(every, return_counts=True)
    met = np.array_split(every, 7)
    tracemalloc.start()
    got = jaccard.often_met(met)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert met == [] and (got[0] == k[n >= 3]).all() and (got[1] == n[n >= 3]).all()
    assert most < 3 * every.nbytes
    assert all(len(x) == 0 for x in jaccard.often_met([]))
