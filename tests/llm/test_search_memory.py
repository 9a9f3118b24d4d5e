"""What a search of the Gray index holds."""

import tracemalloc

import numpy as np

from tessera.llm import simhash


def test_search_of_many_codes_holds_little():
    codes = np.unique(np.random.RandomState(5).randint(-(2**63), 2**63, 8192, dtype=np.int64).view(np.uint64))
    index = simhash.GrayIndex(codes)
    tracemalloc.start()
    q, found = index.search(codes[:4096], 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (codes[q] == index.codes[found]).all() and len(q) == 4096
    assert peak < 150e6
