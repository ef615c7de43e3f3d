"""A bidirectional LSTM in numpy that labels every element of a sequence."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLstm:
    def __init__(self, inputs: int, hidden: int, seed: int):
        r = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for side in "fb":
            self.p[f"w{side}"] = r.normal(0, (1.0 / (inputs + hidden)) ** 0.5, (inputs + hidden, 4 * hidden)).astype(np.float32)
            self.p[f"b{side}"] = np.zeros(4 * hidden, np.float32)
            self.p[f"b{side}"][hidden : 2 * hidden] = 1  # remember at first
        self.p["out"] = r.normal(0, 0.1, 2 * hidden).astype(np.float32)
        self.p["bias"] = np.zeros(1, np.float32)

    def _direction(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool):
        """Hidden states (steps, rows, hidden) of x (steps, rows, inputs); masked steps leave the state as it is."""
        steps, rows, _ = x.shape
        n, w, b = self.hidden, self.p[f"w{side}"], self.p[f"b{side}"]
        into = x @ w[: x.shape[2]] + b
        h = np.zeros((rows, n), np.float32)
        c = np.zeros((rows, n), np.float32)
        out = np.zeros((steps, rows, n), np.float32)
        trace = []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = into[t] + h @ w[x.shape[2] :]
            i, f, o = _sigmoid(z[:, :n]), _sigmoid(z[:, n : 2 * n]), _sigmoid(z[:, 2 * n : 3 * n])
            g = np.tanh(z[:, 3 * n :])
            m = mask[t][:, None]
            c2 = f * c + i * g
            s = np.tanh(c2)
            if keep:
                trace.append((t, h, c, i, f, o, g, s, m))
            h = np.where(m, o * s, h)
            c = np.where(m, c2, c)
            out[t] = h
        return out, trace

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        n = self.hidden
        f, _ = self._direction(x, mask, "f", False)
        b, _ = self._direction(x, mask, "b", False)
        return f @ self.p["out"][:n] + b @ self.p["out"][n:] + self.p["bias"][0]

    def _gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        n = self.hidden
        states = {s: self._direction(x, mask, s, True) for s in "fb"}
        z = states["f"][0] @ self.p["out"][:n] + states["b"][0] @ self.p["out"][n:] + self.p["bias"][0]
        dz = (_sigmoid(z) - y) * weight / max(1.0, float(weight.sum()))
        both = np.concatenate([states["f"][0], states["b"][0]], axis=2)
        g = {"out": np.einsum("trh,tr->h", both, dz), "bias": np.array([dz.sum()])}
        for k, side in enumerate("fb"):
            w = self.p[f"w{side}"]
            d = x.shape[2]
            dw, db = np.zeros_like(w), np.zeros(4 * n, np.float32)
            into = dz[:, :, None] * self.p["out"][k * n : (k + 1) * n]
            dh = np.zeros((x.shape[1], n), np.float32)
            dc = np.zeros((x.shape[1], n), np.float32)
            for t, h, c, i, f, o, gg, s, m in reversed(states[side][1]):
                dh = dh + into[t]
                up = np.where(m, dh, 0)
                dcc = np.where(m, dc, 0) + up * o * (1 - s * s)
                dgate = np.concatenate([dcc * gg * i * (1 - i), dcc * c * f * (1 - f), up * s * o * (1 - o), dcc * i * (1 - gg * gg)], axis=1)
                dw[:d] += x[t].T @ dgate
                dw[d:] += h.T @ dgate
                db += dgate.sum(axis=0)
                dh = np.where(m, 0, dh) + dgate @ w[d:].T
                dc = np.where(m, dcc * f, dc)
            g[f"w{side}"], g[f"b{side}"] = dw, db
        return g

    def fit(self, sequences: list[tuple], epochs: int, seed: int, rate: float = 0.01, rows: int = 32) -> None:
        """Adam over sequences (x, y, weight); those of like length go together."""
        r = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        turn = 0
        for _ in range(epochs):
            order = sorted(r.permutation(len(sequences)), key=lambda i: len(sequences[i][0]))
            parts = [order[i : i + rows] for i in range(0, len(order), rows)]
            for at in r.permutation(len(parts)):
                x, mask, extra = padded([sequences[i] for i in parts[at]])
                turn += 1
                for k, g in self._gradients(x, mask, *extra).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    scale = (1 - 0.999**turn) ** 0.5 / (1 - 0.9**turn)
                    self.p[k] -= (rate * scale * first[k] / (np.sqrt(second[k]) + 1e-7)).astype(np.float32)

    def predict(self, sequences: list[np.ndarray], rows: int = 256) -> list[np.ndarray]:
        """Probabilities of every element of every sequence."""
        out: list = [None] * len(sequences)
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        start = 0
        while start < len(order):
            stop, longest = start, 0
            while stop < len(order) and stop - start < rows:
                longest = max(longest, len(sequences[order[stop]]))
                if stop > start and longest * (stop - start + 1) > 60_000:
                    break
                stop += 1
            part = order[start:stop]
            x, mask, _ = padded([(sequences[i],) for i in part])
            z = self.logits(x, mask)
            for j, i in enumerate(part):
                out[i] = _sigmoid(z[: len(sequences[i]), j])
            start = stop
        return out


def padded(sequences: list[tuple]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(steps, rows, inputs), mask (steps, rows), and the other members of the tuples padded alike."""
    steps = max(1, max(len(s[0]) for s in sequences))
    width = sequences[0][0].shape[1]
    x = np.zeros((steps, len(sequences), width), np.float32)
    mask = np.zeros((steps, len(sequences)), bool)
    extra = [np.zeros((steps, len(sequences)), np.float32) for _ in sequences[0][1:]]
    for j, s in enumerate(sequences):
        x[: len(s[0]), j] = s[0]
        mask[: len(s[0]), j] = True
        for e, v in zip(extra, s[1:], strict=True):
            e[: len(v), j] = v
    return x, mask, extra
