"""A gated recurrent layer and its training step, in numpy.

Gates and candidate use piecewise linear activations (0..1 and -1..1), which cost a
few arithmetic operations per unit.  Rows are units, columns are sequences.
"""

from __future__ import annotations

import numpy as np


class Gated:
    """One layer over symbols: reset and update gates, then the candidate state."""

    def __init__(self, units: int, symbols: int, rng: np.random.Generator):
        self.units = units
        self.table = (rng.standard_normal((3 * units, symbols)) * 0.3).astype(np.float32)
        self.table[: 2 * units] += 0.5  # the middle of the linear gates
        self.inner = (rng.standard_normal((3 * units, units)) * 0.3 / np.sqrt(units)).astype(np.float32)
        self.bias = np.zeros((units, 1), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.inner, self.bias]

    def step(
        self, at: np.ndarray, rows: np.ndarray, state: np.ndarray, out: np.ndarray, keep: list | None = None
    ) -> np.ndarray:
        """The state after one more symbol of every sequence, written to ``out``.

        ``rows`` has the table's entries by symbol: whole rows are gathered faster.
        """
        u = self.units
        x = np.ascontiguousarray(rows.take(at, axis=0).T)
        g = self.inner @ state
        gates = x[: 2 * u]
        gates += g[: 2 * u]
        opened = gates.clip(0, 1)
        reset, update = opened[:u], opened[u:]
        hidden = g[2 * u :]
        hidden += self.bias
        wish = x[2 * u :]
        wish += reset * hidden
        new = wish.clip(-1, 1)
        if keep is not None:
            keep.append((at, state, gates, opened, hidden, wish, new))
        np.subtract(state, new, out=out)
        out *= update
        out += new
        return out

    def run(
        self, symbols: np.ndarray, state: np.ndarray | None = None, goes_on: np.ndarray | None = None, keep: list | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """States after every symbol of (time, lanes), and the last one.

        Where ``goes_on`` (time, lanes) is 0 the state is cleared before the symbol.
        """
        if state is None:
            state = np.zeros((self.units, symbols.shape[1]), np.float32)
        out = np.empty((len(symbols), self.units, symbols.shape[1]), np.float32)
        rows = np.ascontiguousarray(self.table.T)
        cleared = [False] * len(symbols) if goes_on is None else (goes_on != 1).any(axis=1).tolist()
        for t, at in enumerate(symbols):
            state = self.step(at, rows, state * goes_on[t] if cleared[t] else state, out[t], keep)
        return out, state

    def gradients(self, kept: list, outer: np.ndarray, goes_on: np.ndarray | None = None) -> list[np.ndarray]:
        """Gradients of the parameters, given those of the states; back to the first step."""
        u, lanes = self.units, outer.shape[2]
        flow = np.zeros((u, lanes), np.float32)
        inner, bias = np.zeros_like(self.inner), np.zeros_like(self.bias)
        inputs = np.empty((len(kept), 3 * u, lanes), np.float32)
        down, back = np.empty((3 * u, lanes), np.float32), np.ascontiguousarray(self.inner.T)
        cleared = [False] * len(kept) if goes_on is None else (goes_on != 1).any(axis=1).tolist()
        for t in range(len(kept) - 1, -1, -1):
            _, state, gates, opened, hidden, wish, new = kept[t]
            reset, update = opened[:u], opened[u:]
            flow += outer[t]
            own = inputs[t]
            d_wish = own[2 * u :]
            np.multiply(flow, wish == new, out=d_wish)  # where nothing was clipped
            d_wish -= d_wish * update
            np.multiply(d_wish, hidden, out=own[:u])
            np.multiply(flow, state - new, out=own[u : 2 * u])
            own[: 2 * u] *= gates == opened
            down[: 2 * u] = own[: 2 * u]
            np.multiply(d_wish, reset, out=down[2 * u :])
            inner += down @ state.T
            bias += np.add.reduce(down[2 * u :], axis=1, keepdims=True)
            flow *= update
            flow += back @ down
            if cleared[t]:
                flow *= goes_on[t]
        at = np.concatenate([k[0] for k in kept])
        # Short numbers are sorted by their digits.
        order = np.argsort(at.astype(np.int16) if self.table.shape[1] < 1 << 15 else at, kind="stable")
        ordered = at[order]
        cuts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        rows = inputs.transpose(0, 2, 1).reshape(-1, 3 * u)
        table = np.zeros((3 * u, self.table.shape[1]), np.float32)
        table[:, ordered[cuts]] = np.add.reduceat(np.ascontiguousarray(rows.take(order, axis=0).T), cuts, axis=1)
        return [table, inner, bias]


class Adam:
    """Adam steps on a list of arrays, with a bound on the gradients' length."""

    def __init__(self, parameters: list[np.ndarray], rate: float):
        self.parameters, self.rate, self.steps = parameters, rate, 0
        self.first = [np.zeros_like(p) for p in parameters]
        self.second = [np.zeros_like(p) for p in parameters]

    def step(self, gradients: list[np.ndarray], rate: float = 1.0) -> None:
        self.steps += 1
        length = np.sqrt(sum(float((g * g).sum()) for g in gradients))
        shrink = min(1.0, 1.0 / max(length, 1e-12))
        for p, g, m, v in zip(self.parameters, gradients, self.first, self.second, strict=True):
            g = g * shrink
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            up = (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)
            p -= (self.rate * rate * up).astype(p.dtype)
