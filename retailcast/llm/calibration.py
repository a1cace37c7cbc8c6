"""Isotonic calibration from counts on a fixed grid of scores."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CELLS = 2_000


@dataclass(frozen=True)
class Isotonic:
    """Nondecreasing map from a raw score to a probability, linear between block centres."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.x, self.y)


def cell(raw: np.ndarray, low: float, high: float) -> np.ndarray:
    """Grid cell of each score; scores outside the range go to the end cells."""
    return np.clip(((raw - low) / (high - low) * CELLS).astype(np.int64), 0, CELLS - 1)


def isotonic(ones: np.ndarray, total: np.ndarray, low: float, high: float, prior: float = 1.0) -> Isotonic:
    """Pool adjacent violators over the grid.

    ``ones`` and ``total`` are label sums and row counts per cell over all rows. Each pooled block is
    shrunk towards the overall rate by ``prior`` rows, so that no probability is exactly 0 or 1.
    Without rows the result is 0.5 everywhere.
    """
    width = (high - low) / CELLS
    centre = low + width * (np.arange(CELLS) + 0.5)
    if total.sum() == 0:
        return Isotonic(np.array([low, high]), np.array([0.5, 0.5]))
    rate = ones.sum() / total.sum()
    blocks: list[list[float]] = []  # label sum, rows, first centre, last centre
    for i in np.flatnonzero(total):
        blocks.append([float(ones[i]), float(total[i]), centre[i], centre[i]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = last
    x, y = [], []
    for s, n, first, last in blocks:
        p = (s + prior * rate) / (n + prior)
        x += [first, last + width * 1e-3]
        y += [p, p]
    return Isotonic(np.array(x), np.maximum.accumulate(np.array(y)))
