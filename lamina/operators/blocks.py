"""Block form: planes of any size as strips, each a row with some whole lines in one contiguous array.

A strip is (keys, strip, data): ``height`` neighbouring lines of a plane. Work along lines is a map over strips. Work along the
other axis needs a transpose: each strip is cut into one block for each strip of the other axis, blocks are shuffled, and a task
puts those of its strip together. So a pass shuffles each element's bytes once, with a few bytes for each block, and a task holds
a strip, whatever the plane's size. Elements are 4 or 8 bytes (real), 8 or 16 (complex); where values are real, only half of
their spectrum is kept, and the mirrored half is folded in where it's read.

Projections sample that half spectrum along lines through its centre. A sample belongs to the strip of its nearest column; its
strip has the columns that taps reach beyond its ends as well. Which samples a strip has, in which order, follows from sizes
alone, so tasks send values without indices. The adjoint scatters into such bands, whose overlapping ends are added once, when
bands are cut across and put together again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.sources import store

from . import fbp, radon, wave

#: Bytes that a task's strip may take.
BUDGET = 64 << 20
#: A strip, the strip read from it, and transforms of it are held at once.
HELD = 6


@dataclass(frozen=True)
class Strips:
    """``rows`` (keys, strip int, data binary) of planes with so many lines of so many elements."""

    rows: DataFrame
    keys: tuple[str, ...]
    lines: int
    length: int
    height: int
    kind: str

    def kept(self) -> Strips:
        """The same, read from a table written in the shared folder: for strips that are read more than once."""
        path = store.scratch(self.rows.sparkSession)
        self.rows.write.parquet(path)
        return replace(self, rows=self.rows.sparkSession.read.schema(self.rows.schema).parquet(path))


def height_for(lines: int, length: int, budget: int = BUDGET, halo: int = 0) -> int:
    """How many lines (of at most 16 bytes an element) a strip has, so that it fits the budget; 1 at least."""
    return max(1, min(lines, budget // (HELD * 16 * max(1, length)) - 2 * halo))


def fits_plane(height: int, width: int, budget: int = BUDGET) -> bool:
    """Whether the operator that holds a whole plane may be used."""
    return HELD * 16 * height * width <= budget


def _kinds(keys: tuple[str, ...], rows: DataFrame) -> str:
    return "".join(f"{k} {dict(rows.dtypes)[k]}, " for k in keys)


def from_long(values: DataFrame, keys: tuple[str, ...], axes: tuple[str, str], lines: int, length: int, height: int, columns: tuple[str, ...] = ("v",), single: bool = False) -> Strips:
    """Long form to strips of lines along the second axis; columns are a value, or a real and an imaginary part. An element
    without a row is 0."""
    line, along = axes
    kind = ("<c8" if single else "<c16") if len(columns) == 2 else ("<f4" if single else "<f8")

    def one(group: pa.Table) -> pa.Table:
        strip = group.column("strip")[0].as_py()
        m = np.zeros((min(height, lines - strip * height), length), kind)
        parts = [group.column(c).to_numpy() for c in columns]
        m[group.column(line).to_numpy() - strip * height, group.column(along).to_numpy()] = parts[0] if len(parts) == 1 else parts[0] + 1j * parts[1]
        return pa.table({**{k: group.column(k)[:1] for k in keys}, "strip": group.column("strip")[:1], "data": [m.tobytes()]})

    cut = values.select(*keys, *axes, *columns).withColumn("strip", F.floor(F.col(line) / height).cast("int"))
    return Strips(cut.groupBy(*keys, "strip").applyInArrow(one, f"{_kinds(keys, values)}strip int, data binary"), keys, lines, length, height, kind)


def to_long(strips: Strips, axes: tuple[str, str], columns: tuple[str, ...] = ("v",)) -> DataFrame:
    """(keys, axes, columns) of strips; no shuffle."""
    line, along = axes
    keys, kind, length, height = strips.keys, strips.kind, strips.length, strips.height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (strip, data) in enumerate(zip(batch.column("strip").to_pylist(), batch.column("data"), strict=True)):
                m = np.frombuffer(data.as_buffer(), kind).reshape(-1, length)
                at = np.indices(m.shape, np.int32).reshape(2, -1)
                parts = (m.real, m.imag) if len(columns) == 2 else (m.real,)
                own = {c: _repeated(batch, c, k, m.size) for c in keys}
                yield pa.RecordBatch.from_pydict({**own, line: at[0] + np.int32(strip * height), along: at[1], **{c: p.ravel().astype(float) for c, p in zip(columns, parts, strict=True)}})

    return strips.rows.mapInArrow(run, f"{_kinds(keys, strips.rows)}{line} int, {along} int, " + ", ".join(f"{c} double" for c in columns))


def _repeated(batch: pa.RecordBatch, column: str, row: int, times: int) -> pa.Array:
    return batch.column(column).take(pa.array(np.full(times, row, np.int32)))


Send = Callable[[int, np.ndarray], Iterator[tuple[int, np.ndarray]]]
Receive = Callable[[int, list[int], list[bytes]], np.ndarray]


def exchanged(strips: Strips, send: Send, receive: Receive, lines: int, length: int, height: int, kind: str) -> Strips:
    """Strips made of what others send: send(strip, matrix) gives (target, array), receive(target, sources, blocks) the new
    strip's matrix from the bytes of arrays in the sources' order."""
    keys, known, size = strips.keys, strips.kind, strips.length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (strip, data) in enumerate(zip(batch.column("strip").to_pylist(), batch.column("data"), strict=True)):
                m = np.frombuffer(data.as_buffer(), known)
                blocks = list(send(strip, m.reshape(-1, size) if size else m))
                own = {c: _repeated(batch, c, k, len(blocks)) for c in keys}
                yield pa.RecordBatch.from_pydict({**own, "target": pa.array([t for t, _ in blocks], pa.int32()), "source": pa.array([strip] * len(blocks), pa.int32()), "data": pa.array([b.tobytes() for _, b in blocks], pa.binary())})

    def put(group: pa.Table) -> pa.Table:
        group = group.sort_by("source")
        made = receive(group.column("target")[0].as_py(), group.column("source").to_pylist(), group.column("data").to_pylist())
        return pa.table({**{k: group.column(k)[:1] for k in keys}, "strip": group.column("target")[:1], "data": [made.astype(kind).tobytes()]})

    kinds = _kinds(keys, strips.rows)
    sent = strips.rows.mapInArrow(cut, f"{kinds}target int, source int, data binary")
    return Strips(sent.groupBy(*keys, "target").applyInArrow(put, f"{kinds}strip int, data binary"), keys, lines, length, height, kind)


def beside(sources: list[int], blocks: list[bytes], kind: str, height: int, lines: int, shape: tuple[int, ...]) -> np.ndarray:
    """Blocks put together along their last axis, which has ``lines`` of the sources' lines; those of a strip that isn't there are 0."""
    out = np.zeros((*shape, lines), kind)
    for source, block in zip(sources, blocks, strict=True):
        first = source * height
        out[..., first : first + height] = np.frombuffer(block, kind).reshape(*shape, -1)
    return out


def stacked(sources: list[int], blocks: list[bytes], kind: str, height: int, lines: int, width: int) -> np.ndarray:
    """The same along the first axis."""
    out = np.zeros((lines, width), kind)
    for source, block in zip(sources, blocks, strict=True):
        out[source * height : (source + 1) * height] = np.frombuffer(block, kind).reshape(-1, width)
    return out


def transposed(strips: Strips, width: int, height: int, before: Callable[[np.ndarray], np.ndarray], after: Callable[[int, np.ndarray], np.ndarray], length: int, kind: str) -> Strips:
    """Strips of the other axis: before() works on lines and makes them ``width`` long; after(first line, lines) on those of the
    other axis, which it makes ``length`` long."""
    lines, tall, each = strips.lines, strips.height, "<c8" if strips.kind in ("<c8", "<f4") else "<c16"

    def send(strip: int, m: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        out = before(m).astype(each)
        for a in range(0, width, height):
            yield a // height, np.ascontiguousarray(out[:, a : a + height].T)

    def receive(target: int, sources: list[int], blocks: list[bytes]) -> np.ndarray:
        rows = min(height, width - target * height)
        return after(target * height, beside(sources, blocks, each, tall, lines, (rows,)))

    return exchanged(strips, send, receive, width, length, height, kind)


class Samples:
    """Where projections at evenly spaced angles sample the half spectrum of n x n images, by strips of ``width`` columns."""

    def __init__(self, n: int, angles: int, width: int):
        radon._checked(n)
        self.n, self.angles, self.width = n, angles, width
        self.mu, self.reach = radon.taps(n)
        at = (np.arange(n) - n // 2) / n
        column = np.rint(2 * n * np.outer(np.cos(np.arange(angles) * np.pi / angles), at)).astype(np.int32).ravel()
        self.mirrored = column < 0  # those of the other half: the same point through the centre, conjugated
        strip = np.abs(column) // width
        self.count = n // width + 1
        self.order = np.argsort(strip, kind="stable").astype(np.int32)  # by strip, then as (t, r)
        self.ends = np.searchsorted(strip[self.order], np.arange(self.count + 1))

    def of(self, strip: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Samples (t * n + r) of a strip, with first <= t < last."""
        own = self.order[self.ends[strip] : self.ends[strip + 1]]
        if last is None:
            return own
        a, b = np.searchsorted(own, (first * self.n, last * self.n))
        return own[a:b]

    def columns(self, strip: int) -> np.ndarray:
        """A strip's columns with those that taps reach beyond its ends."""
        return np.arange(strip * self.width - self.reach, min((strip + 1) * self.width, self.n + 1) + self.reach)

    def folded(self, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where columns are in the half spectrum, and which are mirrored there."""
        c = columns % (2 * self.n)
        return np.where(c > self.n, 2 * self.n - c, c), c > self.n

    def taps(self, strip: int, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each tap of the samples: places in the strip's (columns x 2n), and weights."""
        n, mu = self.n, self.mu
        t, r = which // n, which % n
        sign = np.where(self.mirrored[which], -1.0, 1.0)
        at, theta = sign * (r - n // 2) / n, t * np.pi / self.angles
        x, y = at * np.cos(theta), -at * np.sin(theta)
        base_x, base_y = np.rint(2 * n * x).astype(int) - self.reach, np.rint(2 * n * y).astype(int) - self.reach
        start = strip * self.width - self.reach
        steps = range(2 * self.reach + 1)
        down = [((base_y + b) % (2 * n), np.exp(-np.pi**2 / mu * ((base_y + b) / (2 * n) - y) ** 2) * (1 - 2 * ((base_y + b) % 2)) * np.pi / mu) for b in steps]
        for a in steps:
            lx = base_x + a
            wx = np.exp(-np.pi**2 / mu * (lx / (2 * n) - x) ** 2) * (1 - 2 * (lx % 2))
            for ly, wy in down:
                yield (lx - start) * (2 * n) + ly, wx * wy


@lru_cache(maxsize=4)
def samples(n: int, angles: int, width: int) -> Samples:
    """Kept in each worker."""
    return Samples(n, angles, width)


def _weights(n: int, angles: int, first: int, count: int) -> np.ndarray:
    """radon.multiplier() of some lines."""
    mu, _ = radon.taps(n)
    at = (np.arange(n) - n // 2) / n
    return np.exp(mu * n * n * (at[first : first + count, None] ** 2 + at[None, :] ** 2)) * ((1 if n % 4 == 0 else -1) / (n * np.sqrt(n * angles)))


def projected(volume: DataFrame, n: int, angles: int, budget: int = BUDGET, single: bool = False) -> DataFrame:
    """radon.projected() for slices (n x n) of any size: three shuffles, of the elements, of their half spectrum and of samples."""
    out = projected_strips(from_long(volume, ("z",), ("y", "x"), n, n, height_for(n, 2 * n, budget), single=single), angles, budget)
    return to_long(out, ("t", "x")).select("t", "z", "x", "v")


def projected_strips(image: Strips, angles: int, budget: int = BUDGET) -> Strips:
    """Strips of projections (t, x) of strips of images (y, x)."""
    tall, n, each = image.height, image.length, "<c8" if image.kind == "<f4" else "<c16"
    _, reach = radon.taps(n)
    width, height = height_for(n + 1, 2 * n, budget, reach), height_for(angles, n, budget)

    def rows(strip: int, m: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        some = samples(n, angles, width)
        half = np.fft.rfft(np.pad(m * _weights(n, angles, strip * tall, len(m)), ((0, 0), (n // 2, n - n // 2))), axis=1).astype(each)
        for target in range(some.count):
            yield target, half[:, some.folded(some.columns(target))[0]]

    def gathered(strip: int, sources: list[int], blocks: list[bytes]) -> np.ndarray:
        some = samples(n, angles, width)
        columns = some.columns(strip)
        lines = stacked(sources, blocks, each, tall, n, len(columns))
        spectrum = np.fft.fft(np.pad(lines, ((n // 2, n - n // 2), (0, 0))), axis=0).T
        mirrored = some.folded(columns)[1]
        spectrum[mirrored] = np.conj(spectrum[mirrored][:, -np.arange(2 * n) % (2 * n)])
        flat, which = spectrum.ravel(), some.of(strip)
        out = np.zeros(len(which), complex)
        for at, w in some.taps(strip, which):
            out += w * flat[at]
        return np.where(some.mirrored[which], np.conj(out), out) / n

    def by_angles(strip: int, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        t = samples(n, angles, width).of(strip) // n
        for first in range(0, angles, height):
            a, b = np.searchsorted(t, (first, first + height))
            if a < b:
                yield first // height, values[a:b]

    def lines(target: int, sources: list[int], blocks: list[bytes]) -> np.ndarray:
        some, first = samples(n, angles, width), target * height
        last = min(angles, first + height)
        m = np.zeros((last - first) * n, complex)
        for source, block in zip(sources, blocks, strict=True):
            m[some.of(source, first, last) - first * n] = np.frombuffer(block, each)
        m = m.reshape(-1, n)
        return np.fft.fftshift(np.fft.ifft(np.fft.ifftshift(m, axes=1), axis=1), axes=1).real / 4

    sampled = exchanged(image, rows, gathered, n + 1, 0, width, each)
    return exchanged(sampled, by_angles, lines, angles, n, height, image.kind)


def back_projected(stack: DataFrame, n: int, angles: int, budget: int = BUDGET, single: bool = False, filter_name: str | None = None) -> DataFrame:
    """radon.back_projected() for slices of any size, of lines that are filtered before if a filter is named."""
    out = back_projected_strips(from_long(stack, ("z",), ("t", "x"), angles, n, height_for(angles, n, budget), single=single), budget, filter_name)
    return to_long(out, ("y", "x")).select("z", "y", "x", "v")


def back_projected_strips(stack: Strips, budget: int = BUDGET, filter_name: str | None = None) -> Strips:
    """The steps of projected_strips() transposed, in reverse."""
    tall, n, angles, each = stack.height, stack.length, stack.lines, "<c8" if stack.kind == "<f4" else "<c16"
    _, reach = radon.taps(n)
    width, height = height_for(n + 1, 2 * n, budget, reach), height_for(n, 2 * n, budget)
    if filter_name:
        fbp.weights(filter_name, n)  # a wrong name fails here, not in a task

    def by_strips(strip: int, m: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        some, first = samples(n, angles, width), strip * tall
        if filter_name:
            (m,) = fbp.filtered_lines(filter_name)(m)
        values = (np.fft.fftshift(np.fft.fft(np.fft.ifftshift(m, axes=1), axis=1), axes=1) / (4 * n * n)).ravel()
        for target in range(some.count):
            which = some.of(target, first, first + len(m))
            if len(which):
                out = values[which - first * n]
                yield target, np.where(some.mirrored[which], np.conj(out), out).astype(each)

    def scattered(strip: int, sources: list[int], blocks: list[bytes]) -> np.ndarray:
        some = samples(n, angles, width)
        which, columns = some.of(strip), some.columns(strip)
        values = np.zeros(len(which), complex)
        for source, block in zip(sources, blocks, strict=True):
            a, b = np.searchsorted(which, (source * tall * n, (source + 1) * tall * n))
            values[a:b] = np.frombuffer(block, each)
        re, im = np.zeros(len(columns) * 2 * n), np.zeros(len(columns) * 2 * n)
        for at, w in some.taps(strip, which):
            re += np.bincount(at, w * values.real, len(re))
            im += np.bincount(at, w * values.imag, len(im))
        return np.fft.ifft((re + 1j * im).reshape(-1, 2 * n), axis=1)[:, n // 2 : n // 2 + n] * (2 * n)

    def across(strip: int, m: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for a in range(0, n, height):
            yield a // height, np.ascontiguousarray(m[:, a : a + height])

    def merged(target: int, sources: list[int], blocks: list[bytes]) -> np.ndarray:
        some, count = samples(n, angles, width), min(height, n - target * height)
        whole = np.zeros((2 * n, count), complex)
        for source, block in zip(sources, blocks, strict=True):
            np.add.at(whole, some.columns(source) % (2 * n), np.frombuffer(block, each).reshape(-1, count))
        image = np.fft.ifft(whole, axis=0)[n // 2 : n // 2 + n].real.T * (2 * n)
        return image * _weights(n, angles, target * height, count)

    bands = exchanged(stack, by_strips, scattered, n + 1, n, width, each)
    return exchanged(bands, across, merged, n, n, height, stack.kind)


def reconstructed(stack: DataFrame, n: int, angles: int, name: str = "ramp", budget: int = BUDGET, single: bool = False) -> DataFrame:
    """fbp.reconstructed() for slices (n x n) of any size: filtered and transformed in one pass of lines."""
    return back_projected(stack, n, angles, budget, single, name)


def propagated(waves: DataFrame, height: int, width: int, distances: tuple[float, ...], voxel: float = 1.38e-6, energy_kev: float = 30.0, budget: int = BUDGET, single: bool = False) -> DataFrame:
    """wave.propagated() of (t, z, x, re, im) for projections of any size and several distances, of one reading of the waves:
    (d, t, z, x, re, im), d counting distances."""
    from_waves = from_long(waves, ("t",), ("z", "x"), height, width, height_for(height, 2 * width, budget), ("re", "im"), single)
    out = []
    for d, distance in enumerate(distances):
        fn = wave._propagated_lines(voxel, energy_kev, distance)

        def forth(m: np.ndarray, fn=fn) -> np.ndarray:
            re, im = fn(m.real, m.imag)
            return re + 1j * im

        done = transposed(from_waves, width, height_for(width, 2 * height, budget), forth, lambda _, m, fn=forth: fn(m), height, from_waves.kind)
        out.append(to_long(done, ("x", "z"), ("re", "im")).select(F.lit(d).alias("d"), "t", "z", "x", "re", "im"))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def retrieved(values: DataFrame, height: int, width: int, distance: float, alpha: float = 5e-4, voxel: float = 1.38e-6, energy_kev: float = 30.0, budget: int = BUDGET, single: bool = False) -> DataFrame:
    """wave.retrieved() for projections (height x width) of any size: half spectra along x, filtered along z, and back."""
    lines = from_long(values, ("t",), ("z", "x"), height, width, height_for(height, width, budget), single=single)
    half, each = width // 2 + 1, "<c8" if single else "<c16"
    strip = height_for(half, height, budget)

    def low_pass(first: int, m: np.ndarray) -> np.ndarray:
        fx, fz = np.fft.rfftfreq(width, voxel)[first : first + len(m), None], np.fft.fftfreq(height, voxel)[None, :]
        passed = alpha / (wave.wavelength(energy_kev) * distance * (fx**2 + fz**2) / (4 * np.pi) + alpha)
        return np.fft.ifft(np.fft.fft(m, axis=1) * passed, axis=1)

    def back(_: int, m: np.ndarray) -> np.ndarray:
        return -np.log(np.maximum(np.fft.irfft(m, n=width, axis=1), 1e-6))

    filtered = transposed(lines, half, strip, lambda m: np.fft.rfft(m, axis=1), low_pass, height, each)
    done = transposed(filtered, height, lines.height, lambda m: m, back, width, lines.kind)
    return to_long(done, ("z", "x")).select("t", "z", "x", "v")
