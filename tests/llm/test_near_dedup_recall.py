"""How many pairs at the very threshold the sketches lose, by size of the sets."""

import numpy as np
import pytest

from wavekin.llm import near_dedup
from wavekin.llm.shingles import mix


def threshold_pairs(n, percent, count, rng):
    """count pairs of sets of about n members, whose similarity is the smallest that is at least percent."""
    both = next(b for b in range(n + 1) if 100 * b >= percent * (2 * n - b))
    for _ in range(count):
        x = mix(rng.integers(0, 2**63, size=2 * n - both).astype(np.uint64))
        yield x[:n], x[n - both :]


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("n", [10, 50, 200, 1000])
def test_pairs_at_the_threshold_are_found(n, percent):
    rng = np.random.default_rng(n + percent)
    count = 2500
    sets = [s for pair in threshold_pairs(n, percent, count, rng) for s in pair]
    registers = np.concatenate([near_dedup.sketch(sets[i : i + 500]) for i in range(0, len(sets), 500)])
    keys = near_dedup.band_keys(registers, near_dedup.band_width(percent))
    a, b = registers[0::2], registers[1::2]
    banded = (keys[0::2] == keys[1::2]).any(axis=1)
    sizes = np.full(count, n)
    estimate = near_dedup.estimate(a, b, sizes, sizes)
    both = next(k for k in range(n + 1) if 100 * k >= percent * (2 * n - k))
    true = both / (2 * n - both)
    # the deviation used for the margin is the one the estimate really has
    assert estimate.std() <= 1.1 * near_dedup.spread(true, sizes)[0]
    likely = estimate >= percent / 100 - near_dedup.MARGIN * near_dedup.spread(percent / 100, sizes)
    assert (banded & likely).all()
