"""SetSketch registers of shingle sets, as arrays of 16-bit values.

Every element draws, for each register, a value from an exponential distribution; the draws of one
element come in ascending order with exponential spacings and visit the registers along a
permutation of its own, so an element stops as soon as its next draw exceeds every register's
minimum. A register keeps the minimum, truncated to floor(1 - log_b(min)). Registers of a union are the
element-wise maxima, and equal registers are the more likely the more similar two sets are.
"""

from __future__ import annotations

import numpy as np

from swingtrace.llm.hashing import mix, salt

REGISTERS = 256  # a power of two, so that every odd step visits all registers
RATE = 20.0
BASE = 1.02
LIMIT = 65535
GRID = np.linspace(0.0, 1.0, 201)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (sets x REGISTERS, uint16) of sets of 64-bit hashes; all zero for an empty set."""
    m = REGISTERS
    minima = np.full((len(sets), m), np.inf)
    flat = minima.reshape(-1)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if len(owner):
        e = np.concatenate(sets)
        order = mix(e ^ np.uint64(0xD1B54A32D192ED03))
        at = (order & np.uint64(m - 1)).astype(np.int64)
        step = (((order >> np.uint64(8)) & np.uint64(m - 1)) | np.uint64(1)).astype(np.int64)
        x = np.zeros(len(e))
        for j in range(m):
            x = x - np.log(_uniform(e + salt(j + 1))) / (RATE * (m - j))
            np.minimum.at(flat, owner * m + at, x)
            if j < 8 or j % 4 == 0:
                going = x < minima.max(axis=1)[owner]
                e, owner, x, at, step = e[going], owner[going], x[going], at[going], step[going]
                if not len(e):
                    break
            at = (at + step) & (m - 1)
    with np.errstate(divide="ignore"):
        k = np.floor(1.0 - np.log(minima) / np.log(BASE))
    return np.clip(np.where(np.isinf(minima), 0, k), 0, LIMIT).astype(np.uint16)


def similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches, given the sizes of the sets."""

    def passes(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0.0, 1.0) * (BASE - 1.0) / BASE) / np.log(BASE)

    more = (a > b).sum(axis=1)[:, None]
    less = (a < b).sum(axis=1)[:, None]
    u = (na / (na + nb))[:, None]
    v = 1.0 - u
    j = GRID[None, :] * np.minimum(u / v, v / u)
    up, down = passes(u - v * j), passes(v - u * j)
    tiny = 1e-12
    score = (
        more * np.log(np.maximum(up, tiny))
        + less * np.log(np.maximum(down, tiny))
        + (a.shape[1] - more - less) * np.log(np.maximum(1.0 - up - down, tiny))
    )
    return np.take_along_axis(j, score.argmax(axis=1)[:, None], axis=1)[:, 0]
