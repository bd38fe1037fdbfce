"""Bands of registers find pairs at the threshold that was asked for."""

import inspect

import numpy as np
import pytest

from shotplane.llm import minhash


def test_near_duplicates_choose_bands_by_threshold():
    assert inspect.signature(minhash.near_duplicates).parameters["band"].default is None
    assert minhash.band_size(85) == minhash.BAND
    for percent in (70, 75, 80, 85, 90):
        b = minhash.band_size(percent)
        assert (1 - (percent / 100) ** b) ** (minhash.REGISTERS // b) < 1e-4


@pytest.mark.parametrize("percent, union", [(80, 100), (85, 100)])
def test_pairs_at_the_threshold_share_a_band(percent, union):
    r = np.random.default_rng(5)
    missed = 0
    for _ in range(3000):
        h = r.integers(0, 1 << 63, union, dtype=np.uint64)
        own = (union - percent) // 2
        a, b = h[: percent + own], np.concatenate([h[:percent], h[percent + own :]])
        x, y = (minhash.band_keys(minhash.sketch(s), minhash.band_size(percent)) for s in (a, b))
        missed += not (x == y).any()
    assert missed <= 1
