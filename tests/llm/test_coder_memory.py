"""The bytes of a block's lanes are put in order a few lanes at a time: large arrays that are used once cost more than the sums on them."""

import tracemalloc

import numpy as np

from footfall.llm import coder


def test_lanes_are_as_a_loop_has_them_and_take_little_memory():
    rng = np.random.default_rng(0)
    words, counts = rng.integers(0, 1 << 60, (200, 150)).astype(np.uint64), rng.integers(0, 9, (200, 150)).astype(np.uint8)
    want = b"".join(int(w).to_bytes(8, "big")[8 - int(n) :] for word, count in zip(words.T, counts.T) for w, n in zip(word, count))
    assert coder._by_lane(words, counts) == counts.sum(0, dtype="<u4").tobytes() + want
    ids = rng.zipf(1.3, 1_000_000) % 40_000
    tracemalloc.start()
    block = coder.encode_block(ids)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30 * len(ids)
    assert (coder.decode_block(block) == ids).all()
