"""SetSketch registers of sets of 64-bit hashes, and what two sketches say about two sets.

Register ``i`` of a set holds ``floor(1 - log_b(x))``, where ``x`` is the
smallest of the exponential values that hash ``i`` gives its elements: the
minimum on an exponential scale, cut to 16 bits.  The register of a union is
the larger of both registers, and with a base near 1 two registers agree
about as often as the sets' Jaccard similarity says.
"""

from __future__ import annotations

import numpy as np

REGISTERS = 240
BASE = 1.02
RATE = 20.0
_TOP = (1 << 15) - 2

_draw = np.random.default_rng(11)
_MULTIPLY = _draw.integers(0, 1 << 64, REGISTERS, dtype=np.uint64) | np.uint64(1)
_ADD = _draw.integers(0, 1 << 64, REGISTERS, dtype=np.uint64)


def registers(hash: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``(sets, REGISTERS)`` int16 registers of the sets ``hash[first[i]:first[i + 1]]``; 0 for an empty set."""
    out = np.zeros((len(first) - 1, REGISTERS), dtype=np.int16)
    filled = np.flatnonzero(np.diff(first))
    if len(filled):
        begin = first[filled]
        least = np.empty((REGISTERS, len(filled)), dtype=np.uint64)
        value = np.empty_like(hash)
        for i in range(REGISTERS):
            np.multiply(hash, _MULTIPLY[i], out=value)
            value += _ADD[i]
            np.minimum.reduceat(value, begin, out=least[i])
        exponential = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2.0**64) / RATE
        scaled = np.floor(1 - np.log(exponential) / np.log(BASE))
        out[filled] = np.clip(scaled, 0, _TOP).astype(np.int16)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the unions."""
    return np.maximum(a, b)


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum likelihood estimates of the Jaccard similarity from the registers of pairs
    and the sets' sizes.

    How often one register exceeds the other has the probability
    ``p(u - v * J)`` with ``p(x) = -log_b(1 - x * (b - 1) / b)`` and ``u``, ``v`` the shares of
    the sizes; the logarithm of the likelihood is concave, so its slope is bisected.
    """
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - above - below
    u = n_a / (n_a + n_b)
    v = 1 - u
    scale, log_base = (BASE - 1) / BASE, np.log(BASE)

    def p(x):
        return -np.log1p(-x * scale) / log_base

    def slope(x):
        return scale / (1 - x * scale) / log_base

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(24):
        j = (low + high) / 2
        x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
        same = np.maximum(1 - p(x) - p(y), 1e-12)
        change = -above * v * slope(x) / p(x) - below * u * slope(y) / p(y) + equal * (v * slope(x) + u * slope(y)) / same
        low, high = np.where(change > 0, j, low), np.where(change > 0, high, j)
    return (low + high) / 2
