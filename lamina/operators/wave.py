"""Wave fields: transmission, free-space propagation and phase retrieval.

The Fresnel kernel is a product of one factor along each axis, so a field is propagated line by line along x, then along z.
Phase retrieval isn't separable: it works on planes, one projection in a task; ``blocks`` has a form for larger ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lines import along, stacks


def wavelength(energy_kev: float) -> float:
    return 1.24e-9 / energy_kev


def fresnel_number(voxel: float, energy_kev: float, distance: float) -> float:
    return voxel**2 / (wavelength(energy_kev) * distance)


def transmitted(values: DataFrame, norm: float, beta_ratio: float = 100.0, phase_scale: float = 1.0) -> DataFrame:
    """v becomes re, im of exp(-phase / beta_ratio + i phase), phase being v phase_scale / norm."""
    phase = F.col("v") * (phase_scale / norm)
    return values.withColumns({"re": F.exp(-phase / beta_ratio) * F.cos(phase), "im": F.exp(-phase / beta_ratio) * F.sin(phase)}).drop("v")


def intensity(re: Column, im: Column) -> Column:
    return re * re + im * im


def _propagated_lines(voxel: float, energy_kev: float, distance: float):
    def fn(re: np.ndarray, im: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = re.shape[1]
        wave = np.pad(re + 1j * im, ((0, 0), (n // 2, n - n // 2)), mode="symmetric")
        kernel = np.exp(-1j * np.pi * wavelength(energy_kev) * distance * np.fft.fftfreq(2 * n, voxel) ** 2)
        out = np.fft.ifft(np.fft.fft(wave, axis=1) * kernel, axis=1)[:, n // 2 : n // 2 + n]
        return out.real, out.imag

    return fn


def propagated(waves: DataFrame, distance: float, voxel: float = 1.38e-6, energy_kev: float = 30.0) -> DataFrame:
    """(t, z, x, re, im) after the distance; axes are mirrored to twice their size, so that no edge is lit from the other side."""
    fn = _propagated_lines(voxel, energy_kev, distance)
    return along(along(waves, "x", ["t", "z"], fn, ("re", "im")), "z", ["t", "x"], fn, ("re", "im")).select("t", "z", "x", "re", "im")


def retrieved(values: DataFrame, distance: float, alpha: float = 5e-4, voxel: float = 1.38e-6, energy_kev: float = 30.0) -> DataFrame:
    """Single-distance phase retrieval of intensities (t, z, x, v): a low-pass filter, then minus the logarithm."""
    return stacks(values, ["t"], ("z", "x"), retrieval(distance, alpha, voxel, energy_kev), ("z", "x")).withColumn("t", F.col("t").cast("int"))


def retrieval(distance: float, alpha: float = 5e-4, voxel: float = 1.38e-6, energy_kev: float = 30.0):
    """The function of retrieved(), of intensities (projections, z, x)."""

    def fn(v: np.ndarray) -> np.ndarray:
        fz, fx = np.meshgrid(np.fft.fftfreq(v.shape[-2], voxel), np.fft.rfftfreq(v.shape[-1], voxel), indexing="ij")
        low_pass = alpha / (wavelength(energy_kev) * distance * (fx**2 + fz**2) / (4 * np.pi) + alpha)
        return -np.log(np.maximum(np.fft.irfft2(np.fft.rfft2(v) * low_pass, s=v.shape[-2:]), 1e-6))

    return fn


def measurement(norm: float, beta_ratio: float, phase_scale: float, distance: float, voxel: float, energy_kev: float):
    """The function from projections (projections, z, x) to the intensities after the distance, as transmitted(), propagated()
    and intensity() give them."""
    along_lines = _propagated_lines(voxel, energy_kev, distance)

    def along_last(wave: np.ndarray) -> np.ndarray:
        re, im = along_lines(wave.real.reshape(-1, wave.shape[-1]), wave.imag.reshape(-1, wave.shape[-1]))
        return (re + 1j * im).reshape(wave.shape)

    def fn(v: np.ndarray) -> np.ndarray:
        phase = v * (phase_scale / norm)
        wave = along_last(np.exp(-phase / beta_ratio) * np.exp(1j * phase))
        wave = along_last(np.ascontiguousarray(wave.swapaxes(-1, -2))).swapaxes(-1, -2)
        return wave.real**2 + wave.imag**2

    return fn
