"""Suppression of vertical stripes in sinograms: wavelet bands of vertical detail, damped at low frequencies along the angle."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import product
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .blocks import Strips
from .lines import stacks


#: Elements of a sinogram up to which its damping, which is linear, is one matrix, kept in each worker.
AS_MATRIX = 400

#: Decomposition low-pass of sym16 (fixed values, as published).
SYM16 = (
    6.230006701220761e-06, -3.113556407621969e-06, -0.00010943147929529757, 2.8078582128442894e-05, 0.0008523547108047095, -0.0001084456223089688, -0.0038809122526038786, 0.0007182119788317892,
    0.012666731659857348, -0.0031265171722710075, -0.031051202843553064, 0.004869274404904607, 0.032333091610663785, -0.06698304907021778, -0.034574228416972504, 0.39712293362064416,
    0.7565249878756971, 0.47534280601152273, -0.054040601387606135, -0.15959219218520598, 0.03072113906330156, 0.07803785290341991, -0.003510275068374009, -0.024952758046290123,
    0.001359844742484172, 0.0069377611308027096, -0.00022211647621176323, -0.0013387206066921965, 3.656592483348223e-05, 0.00016545679579108483, -5.396483179315242e-06, -1.0797982104319795e-05,
)


@lru_cache(maxsize=8)
def scaling(name: str) -> np.ndarray:
    """Reconstruction low-pass of ``haar``, ``dbN`` or ``symN``, from the roots of the half-band polynomial: inside the unit
    circle for dbN, for other symN the choice of each pair whose phase is nearest to a line; ``sym16`` as published."""
    if name == "sym16":
        return np.array(SYM16[::-1])
    if name != "haar" and not re.fullmatch(r"(db|sym)\d+", name):
        raise ValueError(f"unknown wavelet {name}; expected haar, dbN or symN")
    order = 1 if name == "haar" else int(name[2:] if name[:2] == "db" else name[3:])
    if order == 1:
        return np.array([1.0, 1.0]) / np.sqrt(2)
    # P(y) with y = (2 - z - 1/z) / 4; each root y gives a pair of roots z and 1/z.
    roots = np.roots([comb(order - 1 + k, k) for k in range(order)][::-1])
    pairs = []
    for y in roots[roots.imag > -1e-9]:
        z = np.roots([1, 4 * y - 2, 1])
        z = z[abs(z).argsort()]
        pairs.append([np.array([x, x.conj()]) if abs(y.imag) > 1e-9 else np.array([x.real]) for x in z])
    def taps(chosen) -> np.ndarray:
        c = np.real(np.poly(np.concatenate([*chosen, -np.ones(order)])))
        return c * np.sqrt(2) / c.sum()

    if name.startswith("db"):
        return taps([p[0] for p in pairs])
    at = np.linspace(0.05, np.pi * 0.9, 200)

    def bend(h: np.ndarray) -> float:
        phase = np.unwrap(np.angle(np.exp(-1j * np.outer(at, np.arange(len(h)))) @ h))
        return float(np.abs(phase - np.polyval(np.polyfit(at, phase, 1), at)).max())

    return min((taps(c) for c in product(*pairs)), key=bend)


def filters(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Analysis and synthesis, low and high pass."""
    low = scaling(name)
    high = low[::-1] * (-1.0) ** np.arange(len(low))
    return low[::-1], high[::-1], low, high


def analysed(v: np.ndarray, low: np.ndarray, high: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """Half as many coefficients of either band along an axis, both ends mirrored."""
    v = np.moveaxis(v, axis, -1)
    n, taps = v.shape[-1], len(low)
    out = (n + taps - 1) // 2
    pad = 2 * (out - 1) - n + taps
    wide = np.pad(v, [(0, 0)] * (v.ndim - 1) + [(pad // 2, (pad + 1) // 2)], mode="symmetric")
    windows = np.lib.stride_tricks.sliding_window_view(wide, taps, axis=-1)[..., ::2, :]
    return tuple(np.moveaxis(windows @ h[::-1], -1, axis) for h in (low, high))


def synthesised(a: np.ndarray, d: np.ndarray, low: np.ndarray, high: np.ndarray, axis: int) -> np.ndarray:
    """The inverse of analysed(), a few elements longer at the end where the length was odd."""
    a, d = np.moveaxis(a, axis, -1), np.moveaxis(d, axis, -1)
    taps, n = len(low), a.shape[-1]
    out = np.zeros((*a.shape[:-1], 2 * n + taps - 2))
    for k in range(taps):
        out[..., k : k + 2 * n : 2] += low[k] * a + high[k] * d
    return np.moveaxis(out[..., taps - 2 : out.shape[-1] - taps + 2], -1, axis)


def _damped(hl: np.ndarray, sigma: float, axis: int) -> np.ndarray:
    """A band of vertical detail without what stays the same along an axis."""
    m = hl.shape[axis]
    k = np.arange(m // 2 + 1)
    at = k if m % 2 else np.minimum(k + 0.5, m - k - 0.5)
    shape = [1] * hl.ndim
    shape[axis] = -1
    return np.fft.irfft(np.fft.rfft(hl, axis=axis) * -np.expm1(-(at**2) / (2 * sigma**2)).reshape(shape), n=m, axis=axis)


def damped(v: np.ndarray, sigma: float, wavelet: str, level: int) -> np.ndarray:
    """An array (angles, x), or each in a stack, with the vertical detail of so many levels damped."""
    if not level:
        return v
    la, ha, ls, hs = filters(wavelet)
    low, high = analysed(v, la, ha, -1)
    (ll, lh), (hl, hh) = analysed(low, la, ha, -2), analysed(high, la, ha, -2)
    ll = damped(ll, sigma, wavelet, level - 1)
    low, high = synthesised(ll, lh, ls, hs, -2), synthesised(_damped(hl, sigma, -2), hh, ls, hs, -2)
    return synthesised(low, high, ls, hs, -1)[..., : v.shape[-2], : v.shape[-1]]


def without_stripes(sino: np.ndarray, sigma: float = 2.0, wavelet: str = "sym16", level: int = 7) -> np.ndarray:
    """A sinogram (angles, x), or each in a stack, without what stays the same over the angles in the bands of detail along x."""
    angles, width = sino.shape[-2:]
    extra = angles // 8
    v = damped(np.pad(sino, [(0, 0)] * (sino.ndim - 2) + [(extra // 2, extra - extra // 2), (0, 0)]), sigma, wavelet, level)
    return v[..., extra // 2 : extra // 2 + angles, :width]


@lru_cache(maxsize=16)
def _matrix(angles: int, width: int, sigma: float, wavelet: str, level: int) -> np.ndarray:
    """without_stripes() of each unit sinogram: a row each."""
    return without_stripes(np.eye(angles * width).reshape(-1, angles, width), sigma, wavelet, level).reshape(angles * width, -1)


def removal(sigma: float = 2.0, wavelet: str = "sym16", level: int = 7):
    """without_stripes() as a function of sinograms (sinograms, angles, x). Small ones are multiplied by a matrix, but for those
    with elements that aren't finite, which would spread otherwise than by the filters."""

    def fn(v: np.ndarray) -> np.ndarray:
        if v[0].size > AS_MATRIX or not np.isfinite(v).all():
            return without_stripes(v, sigma, wavelet, level)
        return (v.reshape(len(v), -1) @ _matrix(*v.shape[1:], sigma, wavelet, level)).reshape(v.shape)

    return fn


def stripes_removed(stack: DataFrame, sigma: float = 2.0, wavelet: str = "sym16", level: int = 7, keys: tuple[str, ...] = ("z",)) -> DataFrame:
    """(t, z, x, v), sinogram by sinogram; keys name what else tells sinograms apart, such as a tile."""
    scaling(wavelet)
    return stacks(stack, list(keys), ("t", "x"), removal(sigma, wavelet, level), ("t", "x")).select("t", *keys, "x", "v")


def stripes_removed_by_strips(stack: DataFrame, angles: int, width: int, sigma: float = 2.0, wavelet: str = "sym16", level: int = 7, keys: tuple[str, ...] = ("z",), budget: int = blocks.BUDGET) -> DataFrame:
    """stripes_removed() for sinograms (angles x width) larger than a task: each level's transform is a pass along x and one
    along the angles, over strips of lines that are whole, so that filters need no halo. Levels whose array has become small
    enough for a task are done there."""
    scaling(wavelet)
    extra = angles // 8
    wide = stack.withColumn("t", (F.col("t") + extra // 2).cast("int"))
    lines = blocks.from_long(wide, keys, ("t", "x"), angles + extra, width, blocks.height_for(angles + extra, width, budget))
    out = blocks.to_long(_damped_strips(lines, sigma, wavelet, level, budget), ("t", "x")).withColumn("t", (F.col("t") - extra // 2).cast("int"))
    return out.where((F.col("t") >= 0) & (F.col("t") < angles)).select("t", *keys, "x", "v")


def _damped_strips(strips: Strips, sigma: float, wavelet: str, level: int, budget: int) -> Strips:
    """damped() of each key's array, by strips of its lines."""
    if not level:
        return strips
    t, w, height, kind, keys = strips.lines, strips.length, strips.height, strips.kind, strips.keys
    if blocks.fits_plane(t, w, budget):

        def whole(_: int, sources: list[int], parts: list[bytes]) -> np.ndarray:
            return damped(blocks.stacked(sources, parts, kind, height, t, w), sigma, wavelet, level)

        return blocks.exchanged(strips, lambda _, m: iter([(0, m)]), whole, t, w, t, kind)

    la, ha, ls, hs = filters(wavelet)
    t2, w2 = (t + len(la) - 1) // 2, (w + len(la) - 1) // 2
    rows, columns = blocks.height_for(t2, w2, budget), blocks.height_for(w2, 2 * t, budget)

    def along_x(_: int, m: np.ndarray):
        both = np.stack(analysed(m, la, ha, 1))
        for a in range(0, w2, columns):
            yield a // columns, np.ascontiguousarray(both[:, :, a : a + columns].transpose(0, 2, 1))

    def along_angles(target: int, sources: list[int], parts: list[bytes]) -> np.ndarray:
        count = min(columns, w2 - target * columns)
        low, high = blocks.beside(sources, parts, kind, height, t, (2, count))
        (ll, lh), (hl, hh) = analysed(low, la, ha, 1), analysed(high, la, ha, 1)
        return np.stack([ll, lh, _damped(hl, sigma, 1), hh])

    def of_lines(_: int, flat: np.ndarray):
        ll = flat.reshape(4, -1, t2)[0]
        for a in range(0, t2, rows):
            yield a // rows, np.ascontiguousarray(ll[:, a : a + rows].T)

    def lines_of(target: int, sources: list[int], parts: list[bytes]) -> np.ndarray:
        return blocks.beside(sources, parts, kind, columns, w2, (min(rows, t2 - target * rows),))

    def columns_of(target: int, sources: list[int], parts: list[bytes]) -> np.ndarray:
        return blocks.beside(sources, parts, kind, tall, t2, (min(columns, w2 - target * columns),))

    def of_columns(_: int, m: np.ndarray):
        for a in range(0, w2, columns):
            yield a // columns, np.ascontiguousarray(m[:, a : a + columns].T)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for bands, inner in zip(batch.column("bands"), batch.column("data"), strict=True):
                _, lh, hl, hh = np.frombuffer(bands.as_buffer(), kind).reshape(4, -1, t2)
                ll = np.frombuffer(inner.as_buffer(), kind).reshape(-1, t2)
                out.append(np.stack([x[:, :t] for x in (synthesised(ll, lh, ls, hs, 1), synthesised(hl, hh, ls, hs, 1))]).tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in (*keys, "strip")], pa.array(out, pa.binary())], names=[*keys, "strip", "data"])

    def of_angles(_: int, flat: np.ndarray):
        both = flat.reshape(2, -1, t)
        for a in range(0, t, height):
            yield a // height, np.ascontiguousarray(both[:, :, a : a + height].transpose(0, 2, 1))

    def back(target: int, sources: list[int], parts: list[bytes]) -> np.ndarray:
        count = min(height, t - target * height)
        low, high = blocks.beside(sources, parts, kind, columns, w2, (2, count))
        return synthesised(low, high, ls, hs, 1)[:, :w]

    # Bands are read twice, for the next level and to go back, so they're written.
    bands = blocks.exchanged(strips, along_x, along_angles, w2, 0, columns, kind).kept()
    lines = _damped_strips(blocks.exchanged(bands, of_lines, lines_of, t2, w2, rows, kind), sigma, wavelet, level - 1, budget)
    tall = lines.height
    inner = blocks.exchanged(lines, of_columns, columns_of, w2, t2, columns, kind)
    both = inner.rows.join(bands.rows.withColumnRenamed("data", "bands"), [*keys, "strip"])
    kinds = "".join(f"{k} {dict(inner.rows.dtypes)[k]}, " for k in keys)
    joined = Strips(both.mapInArrow(made, f"{kinds}strip int, data binary"), keys, w2, 0, columns, kind)
    return blocks.exchanged(joined, of_angles, back, t, w, height, kind)
