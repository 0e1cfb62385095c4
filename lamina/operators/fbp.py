"""Filtered back-projection: a filter along each detector line, then the adjoint of the projection."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .lines import along
from .radon import adjoint, back_projected

FILTERS = ("none", "ramp", "shepp", "cosine", "cosine2", "hamming", "hann", "parzen")
#: Points of the quadrature and samples of its linear end (fixed values).
POINTS, TAPER = 12, 40


def quadrature(t: np.ndarray, points: int = POINTS) -> np.ndarray:
    """Weights w with sum(w f(t)) near the integral of t f(t): on every interval the mean over all runs of ``points`` grid
    points around it of the integral of the polynomial through them."""
    total = len(t)
    u = np.linspace(0.0, 1.0, points)
    basis = np.linalg.inv(np.vander(u, increasing=True))  # column i: coefficients of the polynomial that is 1 at u[i]
    power = np.arange(points)
    moment = lambda extra: np.diff(u[:, None] ** (power + 1 + extra) / (power + 1 + extra), axis=0) @ basis  # noqa: E731  interval, point
    zeroth, first = moment(0), moment(1)
    runs = total - points + 1
    if runs < points:
        raise ValueError(f"too few frequencies for the quadrature: {total}")
    interval = np.arange(total - 1)
    covered = np.minimum(np.minimum(interval + 1, points - 1), total - 1 - interval)
    weights = np.zeros(total)
    for j in range(runs):
        width = t[j + points - 1] - t[j]
        share = 1.0 / covered[j : j + points - 1]
        weights[j : j + points] += share @ (width**2 * first + width * t[j] * zeroth)
    if total > TAPER:
        weights[-TAPER:] = weights[-TAPER] / (total - TAPER) * np.arange(total - TAPER, total)
    return weights


@lru_cache(maxsize=16)
def weights(name: str, n: int) -> np.ndarray:
    """The filter for lines of n samples, at the frequencies of a line of 4n."""
    if name not in FILTERS:
        raise ValueError(f"unknown filter {name}; expected one of {', '.join(FILTERS)}")
    wide = 4 * n
    t = np.arange(wide // 2 + 1) / wide
    if name == "none":
        w = np.full(len(t), wide / 2)
        w[0] *= 2
    else:
        window = {
            "ramp": np.ones_like(t), "shepp": np.sinc(t), "cosine": np.cos(np.pi * t), "cosine2": np.cos(np.pi * t) ** 2,
            "hamming": 0.54 + 0.46 * np.cos(2 * np.pi * t), "hann": (1 + np.cos(2 * np.pi * t)) / 2, "parzen": (1 - 2 * t) ** 3,
        }[name]
        w = wide / 2 * quadrature(t) * window
    w = 2 * np.where(w >= 0, w, 0.0)
    w[0] *= 2
    return (3 * n * w).astype(np.float32).astype(float)


def filtered_lines(name: str):
    def fn(v: np.ndarray) -> tuple[np.ndarray]:
        n = v.shape[1]
        before = 3 * n // 2
        wide = np.pad(v, ((0, 0), (before, 3 * n - before)), mode="edge")
        return (np.fft.irfft(np.fft.rfft(wide, axis=1) * weights(name, n), n=4 * n, axis=1)[:, before : before + n],)

    return fn


def filtered(stack: DataFrame, name: str = "ramp") -> DataFrame:
    """(t, z, x, v) filtered along x; ends are continued by their last value."""
    weights(name, 64)  # a wrong name fails here, not in a task
    return along(stack, "x", ["t", "z"], filtered_lines(name))


def reconstruction(name: str = "ramp"):
    """The function from sinograms (slices, angles, x) to slices (slices, y, x), as reconstructed() gives them."""
    weights(name, 64)
    along_lines = filtered_lines(name)
    return lambda v: adjoint(along_lines(v.reshape(-1, v.shape[-1]))[0].reshape(v.shape))


def reconstructed(stack: DataFrame, name: str = "ramp") -> DataFrame:
    """(z, y, x, v) from projections (t, z, x, v) at evenly spaced angles over half a turn."""
    return back_projected(filtered(stack, name))
