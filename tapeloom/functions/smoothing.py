"""Recursive smoothing of one series: the only indicators that windows can't express."""

from __future__ import annotations

import numpy as np


def smooth(x: np.ndarray, n: int, alpha: float) -> np.ndarray:
    """y = y + alpha (x - y), seeded by the mean of the first n values that exist; NaN before."""
    out = np.full(len(x), np.nan)
    start = int(np.argmax(~np.isnan(x))) if (~np.isnan(x)).any() else len(x)
    seed = start + n - 1
    if seed < len(x):
        y = x[start : seed + 1].mean()
        out[seed] = y
        for i in range(seed + 1, len(x)):
            y += alpha * (x[i] - y)
            out[i] = y
    return out


def ema(x: np.ndarray, n: int) -> np.ndarray:
    return smooth(x, n, 2 / (n + 1))


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    return smooth(x, n, 1 / n)


def before(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[np.nan], x[:-1]])


def rsi(c: np.ndarray, n: int) -> np.ndarray:
    """100 without losses, NaN if the price never moved."""
    d = c - before(c)
    gain, loss = wilder(np.where(np.isnan(d), np.nan, np.maximum(d, 0)), n), wilder(np.where(np.isnan(d), np.nan, np.maximum(-d, 0)), n)
    total = gain + loss
    return np.where(total > 0, 100 * gain / np.where(total > 0, total, 1), np.nan)


def true_range(h: np.ndarray, l: np.ndarray, c: np.ndarray) -> np.ndarray:
    p = before(c)
    return np.where(np.isnan(p), np.nan, np.maximum(h - l, np.maximum(np.abs(h - p), np.abs(l - p))))


def adx(h: np.ndarray, l: np.ndarray, c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ADX, +DI and -DI; 0 where nothing moved. Wilder's sums are n times his means, so the means serve."""
    up, down = h - before(h), before(l) - l
    plus = np.where(np.isnan(up), np.nan, np.where((up > down) & (up > 0), up, 0))
    minus = np.where(np.isnan(up), np.nan, np.where((down > up) & (down > 0), down, 0))
    tr = wilder(true_range(h, l, c), n)
    zero = lambda a, b: np.where(np.isnan(b), np.nan, np.where(b > 0, 100 * a / np.where(b > 0, b, 1), 0))
    pdi, mdi = zero(wilder(plus, n), tr), zero(wilder(minus, n), tr)
    return wilder(zero(np.abs(pdi - mdi), pdi + mdi), n), pdi, mdi
