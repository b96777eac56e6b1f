"""The table of codewords is built in every Python worker, so what that takes for a moment counts as often as there are workers."""

import tracemalloc

import numpy as np

from footfall.llm import golay


def test_table_takes_little_more_than_itself():
    golay.nearest_table.cache_clear()
    tracemalloc.start()
    table = golay.nearest_table()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < table.nbytes + (16 << 20)


def test_table_corrects_up_to_three_errors():
    words = np.random.default_rng(0).integers(0, 1 << 12, 200)
    code = np.array([(int(w) << golay.CHECKS) | int(golay._remainder(np.array([int(w) << golay.CHECKS]))[0]) for w in words])
    for bits in ((), (0,), (22, 3), (1, 11, 21)):
        assert (golay.nearest(code ^ sum(1 << b for b in bits)) == words).all()
