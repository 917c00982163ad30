"""Bidirectional LSTM in numpy: forward, gradients, Adam. Sequences are (steps, batch, features)."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class BiLSTM:
    """Parameters `p`: for each direction d (f, b) weights W of input and state, and bias."""

    def __init__(self, inputs: int, hidden: int, rng: np.random.Generator):
        self.hidden = hidden
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"W{d}"] = (rng.standard_normal((inputs, 4 * hidden)) / np.sqrt(inputs)).astype(np.float32)
            self.p[f"U{d}"] = (rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1  # remember at first
            self.p[f"c{d}"] = bias

    def _one(self, d: str, drive: np.ndarray, mask: np.ndarray | None, keep: list | None) -> np.ndarray:
        """States of one direction; drive is input x W + bias."""
        n, u = self.hidden, self.p[f"U{d}"]
        steps = range(len(drive)) if d == "f" else range(len(drive) - 1, -1, -1)
        out = np.zeros((*drive.shape[:2], n), np.float32)
        h = c = np.zeros((drive.shape[1], n), np.float32)
        for t in steps:
            z = drive[t] + h @ u
            gates, g = _sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            new = f * c + i * g
            live = np.tanh(new)
            h_new = o * live
            if mask is not None:  # beyond its end a sequence has no state
                m = mask[t][:, None]
                new, h_new = new * m, h_new * m
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, live))
            h, c = h_new, new
            out[t] = h
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray | None = None, keep: dict | None = None) -> np.ndarray:
        both = []
        for d in "fb":
            drive = x @ self.p[f"W{d}"] + self.p[f"c{d}"]
            trace: list | None = [] if keep is not None else None
            both.append(self._one(d, drive, mask, trace))
            if keep is not None:
                keep[d] = trace
        return np.concatenate(both, axis=2)

    def backward(self, x: np.ndarray, grad: np.ndarray, keep: dict, mask: np.ndarray | None = None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        n, dx, out = self.hidden, np.zeros_like(x), {}
        for k, d in enumerate("fb"):
            u, w = self.p[f"U{d}"], self.p[f"W{d}"]
            dz = np.zeros((*x.shape[:2], 4 * n), np.float32)
            du = np.zeros_like(u)
            dh_next = dc_next = np.zeros((x.shape[1], n), np.float32)
            for t, h, c, i, f, o, g, live in reversed(keep[d]):
                dh, dc_add = grad[t][:, k * n : (k + 1) * n] + dh_next, dc_next
                if mask is not None:
                    m = mask[t][:, None]
                    dh, dc_add = dh * m, dc_add * m
                dc = dc_add + dh * o * (1 - live * live)
                dz[t] = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * live * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                du += h.T @ dz[t]
                dh_next, dc_next = dz[t] @ u.T, dc * f
            flat = dz.reshape(-1, 4 * n)
            out[f"W{d}"], out[f"U{d}"], out[f"c{d}"] = x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(axis=0)
            dx += (flat @ w.T).reshape(x.shape)
        return dx, out


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        size = np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in grads.values()))
        for k, g in grads.items():
            g = g * min(1.0, 5.0 / (size + 1e-9))
            self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            self.v[k] = 0.99 * self.v.get(k, 0) + 0.01 * g * g
            params[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8)).astype(params[k].dtype)
