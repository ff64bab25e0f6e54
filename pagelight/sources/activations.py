"""Activations of a network: steps x features of one line, on a grid of rows x columns (step = row * columns + column), as single-precision numbers or as whole
numbers of 127ths."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


class Activations:
    """Whole numbers take values from -1 to 1; what lies beyond is cut off there."""

    def __init__(self, steps: int, features: int, whole: bool = False, rows: int = 1) -> None:
        self.whole = whole
        self.resize(steps, features, rows)

    @classmethod
    def of(cls, grid: np.ndarray, whole: bool = False) -> Activations:
        """Of rows x columns x features, as `network.forward` takes and gives them."""
        h, w, n = grid.shape
        out = cls(h * w, n, whole, h)
        out.values[:] = out._stored(grid.reshape(-1, n))
        return out

    def resize(self, steps: int, features: int, rows: int = 1) -> None:
        """New sizes; all is zero afterwards."""
        if rows < 1 or steps % rows:
            raise ValueError(f"{steps} steps aren't {rows} rows")
        self.steps, self.features, self.rows, self.columns = steps, features, rows, steps // rows
        self.values = np.zeros((steps, features), np.int8 if self.whole else np.float32)

    def _stored(self, data: np.ndarray) -> np.ndarray:
        if not self.whole:
            return data.astype(np.float32)
        scaled = np.clip(data.astype(np.float32) * np.float32(127), -127, 127)
        return (np.sign(scaled) * np.floor(np.abs(scaled) + np.float32(0.5))).astype(np.int8)

    def _step(self, t: int) -> np.ndarray:
        if not 0 <= t < self.steps:
            raise ValueError(f"step {t} of {self.steps}")
        return self.values[t]

    def write(self, t: int, data: Sequence[float]) -> None:
        if len(data) != self.features:
            raise ValueError(f"{len(data)} values for {self.features} features")
        self._step(t)[:] = self._stored(np.asarray(data))

    def read(self, t: int) -> np.ndarray:
        return self._step(t) / np.float32(127) if self.whole else self._step(t).copy()

    def whole_numbers(self, t: int) -> np.ndarray:
        if not self.whole:
            raise ValueError("these activations aren't whole numbers")
        return self._step(t)

    def copy_step(self, t: int, other: Activations, of: int) -> None:
        if (self.features, self.whole) != (other.features, other.whole):
            raise ValueError("activations of another form")
        self._step(t)[:] = other._step(of)

    def zero(self, t: int) -> None:
        self._step(t)[:] = 0

    def grid(self) -> np.ndarray:
        """Rows x columns x features in single precision."""
        found = self.values / np.float32(127) if self.whole else self.values
        return found.astype(np.float32).reshape(self.rows, self.columns, self.features)
