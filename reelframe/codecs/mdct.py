"""Transform stages of lossy audio: sine window, MDCT and its inverse, overlap-add, quantisation by the peak."""

from __future__ import annotations

import numpy as np


def sine_window(n: int) -> np.ndarray:
    return np.sin(np.pi * (np.arange(n) + 0.5) / n)


def _basis(n: int) -> np.ndarray:
    """Cosines (n, n/2) of blocks of n samples."""
    t, k = np.arange(n)[:, None], np.arange(n // 2)[None]
    return np.cos(2 * np.pi / n * (t + 0.5 + n / 4) * (k + 0.5))


def mdct(blocks: np.ndarray) -> np.ndarray:
    """Coefficients (m, n/2) of blocks (m, n), as windowed."""
    return blocks @ _basis(blocks.shape[1])


def imdct(coefficients: np.ndarray) -> np.ndarray:
    """Blocks (m, n) that give the signal back once windowed and overlapped."""
    half = coefficients.shape[1]
    return coefficients @ _basis(2 * half).T * (2 / half)


def analyse(x: np.ndarray, n: int = 2048) -> np.ndarray:
    """Coefficients of half-overlapping windowed blocks of a signal, which is padded by half a block at both ends."""
    half = n // 2
    x = np.pad(x, (half, half + -len(x) % half))
    return mdct(np.stack([x[i : i + n] for i in range(0, len(x) - half, half)]) * sine_window(n))


def synthesise(coefficients: np.ndarray, size: int) -> np.ndarray:
    """The signal of analyse's coefficients: each block's first half on the half before, which it completes."""
    half = coefficients.shape[1]
    y = imdct(coefficients) * sine_window(2 * half)
    return (y[:-1, half:] + y[1:, :half]).reshape(-1)[:size]


def quantise(spectrum: np.ndarray) -> tuple[np.ndarray, float]:
    """Integers of at most 127 and their scale, 127 over the peak (1 for silence)."""
    peak = float(np.abs(spectrum).max(initial=0.0))
    scale = 127 / peak if peak > 0 else 1.0
    scaled = spectrum * scale
    return (np.floor(np.abs(scaled) + 0.5) * np.sign(scaled)).astype(np.int16), scale
