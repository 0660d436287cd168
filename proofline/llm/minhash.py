"""MinHash signatures of shingle sets, and how many bands and rows a threshold and a recall ask for."""

from __future__ import annotations

import numpy as np

from proofline.llm.wordhash import U64, mix

_SEED = 20240607


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """The fewest bands of ``rows`` rows by which a pair at ``threshold`` meets with probability ``recall``."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))


def band_hashes(sets: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per band for each set; ``sets`` are shingle hashes one set after another, cut at ``bounds``.

    Empty sets get zeros. A value's permutations are odd multiples of it plus an offset, mixed by a shift.
    """
    rng = np.random.default_rng(_SEED)
    factor = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) | U64(1)
    offset = rng.integers(1, 2**63, bands * rows, dtype=np.uint64)
    filled = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros((len(bounds) - 1, bands), np.uint64)
    if not len(filled):
        return out
    begin = bounds[filled]
    with np.errstate(over="ignore"):
        for band in range(bands):
            total = np.full(len(filled), U64(band + 1))
            for row in range(rows):
                k = band * rows + row
                value = sets * factor[k]
                value += offset[k]
                least = np.minimum.reduceat(value >> U64(16), begin)
                total = mix(total * U64(0x9E3779B97F4A7C15) + least)
            out[filled, band] = total
    return out
