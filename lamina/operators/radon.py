"""Parallel-beam projections and their adjoint through a non-uniform Fourier transform.

By the slice theorem the transform of a projection is the image's transform along a line through the centre. The image's
spectrum on a grid of twice the size is interpolated there by a Gaussian of a few taps, which the image is divided by before.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lines import stacks

#: The accuracy that the Gaussian's width is chosen for (fixed value).
EPS = 1e-3


def taps(n: int) -> tuple[float, int]:
    """The Gaussian's parameter and its reach in grid points for images of n x n."""
    mu = -math.log(EPS) / (2 * n * n)
    return mu, math.ceil(2 * n / math.pi * math.sqrt(-mu * math.log(EPS) + (mu * n) ** 2 / 4))


def _checked(n: int) -> None:
    if n % 2:
        raise ValueError(f"images must have an even size, not {n}")


class Transform:
    """Of images of n x n at the angles (radians)."""

    def __init__(self, n: int, theta: np.ndarray):
        _checked(n)
        self.n, self.theta = n, theta
        mu, reach = taps(n)
        at = (np.arange(n) - n // 2) / n
        sign = 1 if n % 4 == 0 else -1
        self.phi = np.exp(mu * n * n * (at[:, None] ** 2 + at[None, :] ** 2)) * sign / (n * math.sqrt(n * len(theta)))
        x = (at[None, :] * np.cos(theta)[:, None]).ravel()
        y = (-at[None, :] * np.sin(theta)[:, None]).ravel()
        self.weights, self.columns, self.lines = [], [], []
        base_x, base_y = np.rint(2 * n * x) - reach, np.rint(2 * n * y) - reach
        for k in range(2 * reach + 1):
            lx, ly = base_x + k, base_y + k
            self.columns.append((lx.astype(int) % (2 * n), np.exp(-np.pi**2 / mu * (lx / (2 * n) - x) ** 2) * (1 - 2 * (lx.astype(int) % 2))))
            self.lines.append((ly.astype(int) % (2 * n), np.exp(-np.pi**2 / mu * (ly / (2 * n) - y) ** 2) * (1 - 2 * (ly.astype(int) % 2)) * np.pi / mu))

    def forward(self, image: np.ndarray) -> np.ndarray:
        """(angles, n) projections of an image (n, n), or of each in a stack: line integrals over sqrt(n * angles)."""
        n, some = self.n, image.shape[:-2]
        wide = np.zeros((*some, 2 * n, 2 * n))
        wide[..., n // 2 : n // 2 + n, n // 2 : n // 2 + n] = image * self.phi
        spectrum = np.fft.fft2(wide).reshape(*some, -1)
        lines = np.zeros((*some, len(self.theta) * n), complex)
        for row, wy in self.lines:
            for column, wx in self.columns:
                lines += wx * wy * spectrum[..., row * 2 * n + column]
        lines = lines.reshape(*some, -1, n) / n
        return np.fft.fftshift(np.fft.ifft(np.fft.ifftshift(lines, axes=-1), axis=-1), axes=-1).real / 4

    def adjoint(self, sino: np.ndarray) -> np.ndarray:
        """(n, n) from (angles, n), or each in a stack: the transpose of forward()."""
        n, some = self.n, sino.shape[:-2]
        lines = np.fft.fftshift(np.fft.fft(np.fft.ifftshift(sino, axes=-1), axis=-1), axes=-1).reshape(-1, len(self.theta) * n) / (4 * n * n)
        spectrum = np.zeros(len(lines) * 4 * n * n, complex)
        first = np.arange(len(lines))[:, None] * (4 * n * n)
        for row, wy in self.lines:
            for column, wx in self.columns:
                at = (first + (row * 2 * n + column)).ravel()
                values = (wx * wy * lines).ravel()
                spectrum.real += np.bincount(at, values.real, len(spectrum))
                spectrum.imag += np.bincount(at, values.imag, len(spectrum))
        wide = np.fft.ifft2(spectrum.reshape(*some, 2 * n, 2 * n)) * (4 * n * n)
        return (wide[..., n // 2 : n // 2 + n, n // 2 : n // 2 + n] * self.phi).real


@lru_cache(maxsize=2)
def transform(n: int, angles: int) -> Transform:
    """For evenly spaced angles over half a turn; kept in each worker."""
    return Transform(n, np.arange(angles) * math.pi / angles)


def forward(angles: int):
    """A function of slices (slices, n, n): their projections (slices, angles, n)."""
    return lambda v: transform(v.shape[-1], angles).forward(v)


def adjoint(v: np.ndarray) -> np.ndarray:
    return transform(v.shape[-1], v.shape[-2]).adjoint(v)


def projected(volume: DataFrame, angles: int) -> DataFrame:
    """(t, z, x, v): projections of each slice (z, y, x, v) at evenly spaced angles over half a turn. A slice is one task's work."""
    made = stacks(volume, ["z"], ("y", "x"), forward(angles), ("t", "x"))
    return made.select("t", F.col("z").cast("int").alias("z"), "x", "v")


def back_projected(stack: DataFrame) -> DataFrame:
    """(z, y, x, v): the adjoint of projected(), slice by slice."""
    return stacks(stack, ["z"], ("t", "x"), adjoint, ("y", "x")).withColumn("z", F.col("z").cast("int"))


def multiplier(n: int, angles: int) -> Column:
    """What an image's element (y, x) is multiplied by before its transform, and its place after the adjoint's."""
    _checked(n)
    mu, _ = taps(n)
    at = lambda k: (F.col(k) - n // 2) / n
    return F.exp(mu * n * n * (at("y") * at("y") + at("x") * at("x"))) * ((1 if n % 4 == 0 else -1) / (n * math.sqrt(n * angles)))


def samples(angles: DataFrame, n: int) -> DataFrame:
    """(t, r, x0, y0): where the spectrum is sampled for angles (t, theta in radians)."""
    at = (F.col("r") - n // 2) / n
    return angles.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("t", "r", (at * F.cos("theta")).alias("x0"), (-at * F.sin("theta")).alias("y0"))


def sample_taps(points: DataFrame, n: int) -> DataFrame:
    """The grid points that each sample is a weighted sum of: (t, r, ky, kx, w)."""
    mu, reach = taps(n)
    spread = points.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(2 * reach)))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(2 * reach))))
    lx = (F.rint(2 * n * F.col("x0")) - reach + F.col("a")).cast("int")
    ly = (F.rint(2 * n * F.col("y0")) - reach + F.col("b")).cast("int")
    near = spread.withColumns({"lx": lx, "ly": ly})
    dx, dy = F.col("lx") / (2.0 * n) - F.col("x0"), F.col("ly") / (2.0 * n) - F.col("y0")
    kx, ky = F.pmod("lx", F.lit(2 * n)), F.pmod("ly", F.lit(2 * n))
    weight = (math.pi / mu) * F.exp(-(math.pi**2) / mu * (dx * dx + dy * dy)) * (1 - 2 * ((kx + ky) % 2))
    return near.select("t", "r", ky.alias("ky"), kx.alias("kx"), weight.alias("w"))


def gathered(spectrum: DataFrame, points: DataFrame, n: int) -> DataFrame:
    """(z, t, r, re, im): a spectrum (z, ky, kx, re, im) on the grid of 2n at the points: an equal-key join of taps."""
    near = sample_taps(points, n).join(spectrum, ["ky", "kx"])
    return near.groupBy("z", "t", "r").agg((F.sum(F.col("w") * F.col("re")) / n).alias("re"), (F.sum(F.col("w") * F.col("im")) / n).alias("im"))


def scattered(values: DataFrame, points: DataFrame, n: int) -> DataFrame:
    """(z, ky, kx, re, im): the transpose of gathered() but for its factor 1 / n; values are (z, t, r, re, im)."""
    near = sample_taps(points, n).join(values, ["t", "r"])
    return near.groupBy("z", "ky", "kx").agg(F.sum(F.col("w") * F.col("re")).alias("re"), F.sum(F.col("w") * F.col("im")).alias("im"))


def bins(points: DataFrame, n: int, width: int) -> DataFrame:
    """(bin, n, first): samples of each strip of the half spectrum's columns, and where the strip begins in their order."""
    column = F.pmod(F.rint(2 * n * F.col("x0")).cast("int"), F.lit(2 * n))
    folded = F.when(column > n, 2 * n - column).otherwise(column)
    counted = points.groupBy(F.floor(folded / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return counted.withColumn("first", F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))  # a row for each strip


def in_strip_order(points: DataFrame, n: int, width: int) -> DataFrame:
    """(bin, place, t, r): samples sorted by their strip, those of one strip as they come; a place counts within its strip."""
    column = F.pmod(F.rint(2 * n * F.col("x0")).cast("int"), F.lit(2 * n))
    strip = F.floor(F.when(column > n, 2 * n - column).otherwise(column) / width).cast("int")
    return points.select("t", "r", strip.alias("bin")).withColumn("place", F.row_number().over(Window.partitionBy("bin").orderBy("t", "r")) - 1)


def bands(points: DataFrame, n: int, height: int) -> DataFrame:
    """(band, t, r): the bands of grid lines that a sample's taps reach, around the ends as well."""
    _, reach = taps(n)
    line = F.pmod(F.rint(2 * n * F.col("y0")).cast("int"), F.lit(2 * n))
    touched = F.array_distinct(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda k: F.floor(F.pmod(line + k, F.lit(2 * n)) / height).cast("int")))
    return points.select("t", "r", F.explode(touched).alias("band"))
