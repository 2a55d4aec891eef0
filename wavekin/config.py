"""Settings of a series index."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SeriesConfig:
    """n: series length; w: segments of a word; bits: bits of a symbol; leaf_size: rows of a leaf before it splits.

    summarization is 'sax' or 'sfa'; strategy 'tree' or 'scan'; binning 'equi-depth' or
    'equi-width'; sample is (count, 'first' | 'stride' | 'hash'); candidates is the
    number of Fourier values among which the most variable are chosen (0: the first);
    split is 'variance', 'informed', 'round-robin' or 'cyclic'.
    """

    n: int
    w: int = 16
    bits: int = 8
    leaf_size: int = 2000
    summarization: str = "sax"
    strategy: str = "tree"
    binning: str = "equi-depth"
    sample: tuple[int, str] = (100_000, "hash")
    candidates: int = 0
    z_normalize: bool = True
    skip_dc: bool = False
    split: str = "variance"

    def __post_init__(self):
        if not 0 < self.w <= min(self.n, 62):
            raise ValueError("w must be positive, at most n and at most 62")
        if not 1 <= self.bits <= 8:
            raise ValueError("bits must be 1 to 8")
        if self.candidates and self.candidates < self.w:
            raise ValueError("candidates must be 0 or at least w")

    @property
    def alphabet(self) -> int:
        return 1 << self.bits

    @property
    def segment(self) -> int:
        """Values averaged into one PAA value."""
        return self.n // self.w
