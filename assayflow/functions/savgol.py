"""Savitzky-Golay weights: least-squares polynomials over a sliding frame, fitted at the ends to the first and last."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column

from .columns import convolve


def weights(window: int, poly: int, deriv: int = 0, at: int | None = None) -> list[float]:
    """Weights over a frame that give the polynomial's derivative at place `at` (the middle by default)."""
    half = window // 2
    at = half if at is None else at
    z = np.arange(window) - at
    design = np.vander(z, poly + 1, increasing=True).astype(float)
    return (np.linalg.pinv(design)[deriv] * math.factorial(deriv)).tolist()


def smoothed(y: np.ndarray, window: int, poly: int) -> np.ndarray:
    """The smoothing filter on a small array of the driver's, by the same rules as filter_array()."""
    n = len(y)
    window += 1 - window % 2
    if window > n:
        window = n - 1 + n % 2
    if window <= poly:
        return np.asarray(y, float)
    half = window // 2
    rows = np.zeros((n, n))
    for k in range(n):
        first = min(max(k - half, 0), n - window)
        rows[k, first : first + window] = weights(window, poly, 0, k - first)
    return rows @ np.asarray(y, float)


def filter_array(a: Column, window: int, poly: int, deriv: int = 0, length: int | None = None) -> Column:
    """The filter on an array column. window is made odd and cut to length; at or below poly the array is unchanged."""
    window += 1 - window % 2
    if length is not None and window > length:
        window = length - 1 + length % 2
    if window <= poly:
        return a
    half = window // 2
    left = [weights(window, poly, deriv, k) for k in range(half)]
    right = [weights(window, poly, deriv, half + 1 + k) for k in range(half)]
    return convolve(a, weights(window, poly, deriv), left, right)
