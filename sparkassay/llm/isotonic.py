"""Isotonic calibration from binned sums: pool adjacent violators over a fixed number of bins."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Calibration:
    """A rising map from raw scores to probabilities; linear between the centres of pooled blocks."""

    centres: tuple[float, ...]
    values: tuple[float, ...]

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        if not self.centres:
            return np.full(len(raw), 0.5)
        return np.clip(np.interp(raw, self.centres, self.values), 0.0, 1.0)


def calibrate(points: list[tuple[float, float, float]], prior_weight: float = 1.0) -> Calibration:
    """From (raw score, sum of labels, rows) of each bin. No rows: 0.5 everywhere.

    Each pooled block's rate is drawn to the overall rate by prior_weight rows, so that a small pure
    block does not claim certainty.
    """
    blocks: list[list[float]] = []  # sum of raw * rows, sum of labels, rows
    for raw, labels, rows in sorted(points):
        blocks.append([raw * rows, labels, rows])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    total = sum(b[2] for b in blocks)
    if not total:
        return Calibration((), ())
    rate = sum(b[1] for b in blocks) / total
    values = [(b[1] + prior_weight * rate) / (b[2] + prior_weight) for b in blocks]
    return Calibration(tuple(b[0] / b[2] for b in blocks), tuple(np.maximum.accumulate(values).tolist()))
