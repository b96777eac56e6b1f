"""Blocks of more ids than the counts of order 0 have room for."""

import numpy as np

from footfall.llm import coder


def test_counts_are_halved_before_they_outgrow_the_range(monkeypatch):
    monkeypatch.setattr(coder, "STEP", 1 << 20)  # as many ids as 32768 times this number by the usual step
    rng = np.random.default_rng(0)
    ids = np.minimum(rng.geometric(0.02, 6000), 300).astype("<u4")
    model = coder.Mixer(300, 8)
    for t in range(600):
        model.predict(8)
        assert int(model.below[-1]) * coder.WEIGHT <= int(coder.BOTTOM) and model.counts.min() >= 1
        model.learn(ids[8 * t : 8 * t + 8].astype(np.int64) % 300)
    assert (coder.decode_block(coder.encode_block(ids)) == ids).all()


def test_steps_over_the_vocabulary_are_few():
    ids = np.arange(1_500_000, dtype=np.uint32) % 40_000
    lanes, length = coder._shape(len(ids))
    assert length <= 256 and (lanes - 1) * length < len(ids) <= lanes * length
    assert coder._shape(4 << 20)[0] == 1 << coder.LANE_BITS  # lanes stay bounded


def test_places_are_those_of_a_plain_search():
    rng = np.random.default_rng(3)
    below = np.concatenate([[0], np.cumsum(rng.integers(1, 1000, 5000))])
    for n in (0, 1, 1 << coder.LANE_BITS):
        value = rng.integers(0, 1 << 40, n)
        value[n // 2 :] %= below[-1]
        assert (coder._places(below, value) == np.searchsorted(below, value, "right") - 1).all()
