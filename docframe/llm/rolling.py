"""Vectorised rolling hashes and minimisers over concatenated texts."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
#: A minimiser is the least key of its window: hash bits above, position below.
POSITION_BITS = 24
#: Positions handled at once; a longer text is cut here, which only ends a run early.
STRIDE = 1 << 22

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers["up"]) < n:
        size = max(1, -(-n // (1 << 16))) << 16
        for name, factor in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, factor, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def forget() -> None:
    """Drop the powers; they are found again when needed."""
    _powers.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64-bit keys over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """``h`` with ``h[j] - h[i]`` the polynomial of ``symbols[i:j]``, still shifted by ``i``."""
    up, _ = powers(len(symbols) + 1)
    h = np.zeros(len(symbols) + 1, dtype=np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * up[: len(symbols)], out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ``symbols[start:end]`` from ``prefix_hash``; equal spans hash alike anywhere."""
    _, down = powers(len(h))
    return mix((h[end] - h[start]) * down[start] + (end - start).astype(np.uint64))


def gram_hash(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` symbols."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = prefix_hash(symbols)
    _, down = powers(len(h))
    return mix((h[k:] - h[:n]) * down[:n])


def super_runs(grams: np.ndarray, valid: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of consecutive windows that share one minimiser occurrence.

    ``grams`` hashes the gram at each position, a window has ``width`` grams, ``valid`` says
    which windows count.  Returns first window, number of windows and minimiser of each run.
    Equal windows choose alike, so they meet under one minimiser; two windows of one run are
    never equal, as their minimiser lies at different distances.
    """
    found = []
    low = np.uint64((1 << POSITION_BITS) - 1)
    for at in range(0, len(valid), STRIDE):
        ok = valid[at : at + STRIDE]
        g = grams[at : at + len(ok) + width - 1]
        key = (g & ~low) | np.arange(len(g), dtype=np.uint64)
        span, least = 1, key
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            rest = width - span
            least = np.minimum(least[:-rest], least[rest:])
        least = least[: len(ok)]
        new = np.ones(len(ok), dtype=bool)
        new[1:] = (least[1:] != least[:-1]) | ~ok[:-1]
        first = np.flatnonzero(new & ok)
        ends = np.flatnonzero(ok & np.append(new[1:] | ~ok[1:], True))
        found.append((first + at, ends - first + 1, g[(least[first] & low).astype(np.int64)]))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))
