"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Arrays are [time, batch, ...].  Training maximises the likelihood of labelled tag
paths (forward-backward over the CRF, back-propagation through time, Adam).
"""

from __future__ import annotations

import numpy as np


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Tagger:
    def __init__(self, symbols: int, tags: int, embed: int = 12, hidden: int = 16, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.hidden, self.tags = hidden, tags
        g = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"e": g(symbols, embed) * 2, "o": g(2 * hidden, tags), "ob": np.zeros(tags, np.float32), "t": np.zeros((tags, tags), np.float32), "s": np.zeros(tags, np.float32)}
        for d in "fb":
            b = np.zeros(4 * hidden, np.float32)
            b[hidden : 2 * hidden] = 1  # forget gates start open
            self.p |= {f"x{d}": g(embed, 4 * hidden), f"h{d}": g(hidden, 4 * hidden), f"b{d}": b}

    def _lstm(self, x, d: str):
        n, batch, h = len(x), x.shape[1], self.hidden
        pre = x @ self.p[f"x{d}"] + self.p[f"b{d}"]
        hs, cs, gates = np.zeros((n + 1, batch, h), np.float32), np.zeros((n + 1, batch, h), np.float32), np.empty((n, batch, 4 * h), np.float32)
        for t in range(n):
            z = pre[t] + hs[t] @ self.p[f"h{d}"]
            z[:, : 3 * h] = _sigmoid(z[:, : 3 * h])
            z[:, 3 * h :] = np.tanh(z[:, 3 * h :])
            cs[t + 1] = z[:, h : 2 * h] * cs[t] + z[:, :h] * z[:, 3 * h :]
            hs[t + 1] = z[:, 2 * h : 3 * h] * np.tanh(cs[t + 1])
            gates[t] = z
        return hs, cs, gates

    def _lstm_back(self, x, d: str, hs, cs, gates, dh_out, grad):
        n, h = len(x), self.hidden
        dz = np.empty_like(gates)
        dh, dc = np.zeros_like(hs[0]), np.zeros_like(cs[0])
        for t in range(n - 1, -1, -1):
            i, f, o, c = (gates[t][:, k * h : (k + 1) * h] for k in range(4))
            dh = dh + dh_out[t]
            tc = np.tanh(cs[t + 1])
            dc = dc + dh * o * (1 - tc**2)
            dz[t][:, :h] = dc * c * i * (1 - i)
            dz[t][:, h : 2 * h] = dc * cs[t] * f * (1 - f)
            dz[t][:, 2 * h : 3 * h] = dh * tc * o * (1 - o)
            dz[t][:, 3 * h :] = dc * i * (1 - c**2)
            dh = dz[t] @ self.p[f"h{d}"].T
            dc = dc * f
        flat = dz.reshape(-1, 4 * h)
        grad[f"x{d}"] = x.reshape(-1, x.shape[-1]).T @ flat
        grad[f"h{d}"] = hs[:-1].reshape(-1, h).T @ flat
        grad[f"b{d}"] = flat.sum(0)
        return dz @ self.p[f"x{d}"].T

    def _forward(self, ids):
        x = self.p["e"][ids]
        f, b = self._lstm(x, "f"), self._lstm(x[::-1], "b")
        both = np.concatenate([f[0][1:], b[0][1:][::-1]], 2)
        return x, f, b, both, both @ self.p["o"] + self.p["ob"]

    def _chain(self, emit):
        """Forward and backward log sums over the CRF's paths, and the log normaliser."""
        n = len(emit)
        a, z = np.empty_like(emit), np.zeros_like(emit)
        a[0] = self.p["s"] + emit[0]
        lse = lambda v, axis: (m := v.max(axis, keepdims=True), np.squeeze(m, axis) + np.log(np.exp(v - m).sum(axis)))[1]
        for t in range(1, n):
            a[t] = lse(a[t - 1][:, :, None] + self.p["t"], 1) + emit[t]
        for t in range(n - 2, -1, -1):
            z[t] = lse(self.p["t"] + (emit[t + 1] + z[t + 1])[:, None, :], 2)
        return a, z, lse(a[-1], 1)

    def marginals(self, ids: np.ndarray) -> np.ndarray:
        """Posterior of each tag at each place, [time, batch, tags]."""
        emit = self._forward(ids)[-1]
        a, z, norm = self._chain(emit)
        return np.exp(a + z - norm[None, :, None])

    def _step(self, ids, tags):
        x, f, b, both, emit = self._forward(ids)
        a, z, norm = self._chain(emit)
        n, batch = ids.shape
        d_emit = np.exp(a + z - norm[None, :, None])
        grad = {"s": d_emit[0].sum(0)}
        np.add.at(grad["s"], tags[0], -1)
        grad["t"] = np.zeros_like(self.p["t"])
        for t in range(1, n):
            pair = a[t - 1][:, :, None] + self.p["t"] + (emit[t] + z[t])[:, None, :] - norm[:, None, None]
            grad["t"] += np.exp(pair).sum(0)
        np.add.at(grad["t"], (tags[:-1].ravel(), tags[1:].ravel()), -1)
        np.add.at(d_emit, (np.arange(n)[:, None], np.arange(batch)[None], tags), -1)
        grad["o"] = both.reshape(n * batch, -1).T @ d_emit.reshape(n * batch, -1)
        grad["ob"] = d_emit.sum((0, 1))
        d_both = d_emit @ self.p["o"].T
        h = self.hidden
        dx = self._lstm_back(x, "f", *f, d_both[:, :, :h], grad)
        dx = dx + self._lstm_back(x[::-1], "b", *b, d_both[::-1, :, h:], grad)[::-1]
        grad["e"] = np.zeros_like(self.p["e"])
        np.add.at(grad["e"], ids, dx)
        return {k: v / batch for k, v in grad.items()}

    def train(self, ids: np.ndarray, tags: np.ndarray, steps: int, batch: int = 64, rate: float = 0.02, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for k in range(1, steps + 1):
            at = rng.integers(0, ids.shape[1], batch)
            grad = self._step(ids[:, at], tags[:, at])
            size = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
            pace = rate * min(1.0, 3 * (1 - k / (steps + 1)))
            for name, g in grad.items():
                g = g * min(1.0, 5 / max(size, 1e-9))
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.999 * v[name] + 0.001 * g * g
                self.p[name] = (self.p[name] - pace * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.999**k)) + 1e-8)).astype(np.float32)
