"""Projections that are stitched while their tiles arrive, in any order.

The state of a band of a projection's lines holds its weighted sums, so it has a bounded size however many tiles cover it.
A band is given when all lines that the catalog says it has came, or as far as it came when the rest is overdue.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lamina.operators.mosaic import BAND

LINE = "scan int, zi int, xi int, t int, z int, row array<double>, arrived timestamp"
STATE = "sums binary, weights binary, seen binary, done boolean"
STITCHED = "scan int, t int, z int, row array<double>, complete boolean"


def expected(tiles: DataFrame, band: int = BAND) -> DataFrame:
    """A row per line of a tile's band: what stitching needs of the catalog, and how many lines its band has in all."""
    bands = F.explode(F.sequence(F.floor(F.col("r_lo") / band).cast("int"), F.floor((F.col("r_hi") - 1) / band).cast("int"))).alias("band")
    parts = tiles.select("scan", "zi", "xi", "r_lo", "r_hi", "c_lo", "c_hi", "c_lo_mirror", "overlap", bands)
    lines = F.least(F.col("r_hi"), (F.col("band") + 1) * band) - F.greatest(F.col("r_lo"), F.col("band") * band)
    width = F.greatest(F.col("c_hi"), F.col("c_lo_mirror") + F.col("c_hi") - F.col("c_lo"))
    totals = parts.groupBy("scan", "band").agg(F.sum(lines * 2).alias("lines"))  # of either half turn one
    widths = tiles.groupBy("scan").agg(F.max(width).alias("n"))
    return parts.join(totals, ["scan", "band"]).join(widths, "scan")


def _assembler(patience_ms: int, height: int):
    def assemble(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scan, t, band = key
        if state.hasTimedOut:
            sums, weights, _, done = state.get
            state.remove()
            if not done:
                yield _given(scan, t, band * height, np.frombuffer(sums).reshape(height, -1), np.frombuffer(weights).reshape(height, -1), False)
            return
        sums = weights = None
        seen, done, latest, lines = set(), False, 0, None
        if state.exists:
            sums, weights, known, done = state.get
            sums, weights = np.frombuffer(sums).copy(), np.frombuffer(weights).copy()
            seen = set(np.frombuffer(known, np.int64).tolist())
        for batch in batches:
            latest = max(latest, int(batch["arrived"].max().timestamp() * 1000))
            if done:
                continue  # copies of lines that were given
            for r in batch.itertuples(index=False):
                lines = r.lines
                code = (((r.zi << 20 | r.xi) << 1 | r.second) << 16) | r.z
                if code in seen:
                    continue
                seen.add(code)
                if sums is None:
                    sums, weights = np.zeros(height * r.n), np.zeros(height * r.n)
                values, width = np.asarray(r.row, float), r.c_hi - r.c_lo
                inner = np.minimum(np.arange(width) + 0.5, np.minimum(width - 0.5 - np.arange(width), r.overlap))
                w = inner * min(r.z + 0.5, r.r_hi - r.r_lo - 0.5 - r.z, r.overlap)
                at = (r.r_lo + r.z - band * height) * r.n + (r.c_lo_mirror if r.second else r.c_lo)
                sums[at : at + width] += (w * values)[:: -1 if r.second else 1]
                weights[at : at + width] += w  # the same from both ends
        if not done and lines is not None and len(seen) >= lines:
            yield _given(scan, t, band * height, sums.reshape(height, -1), weights.reshape(height, -1), True)
            sums, weights, seen, done = np.zeros(0), np.zeros(0), set(), True
        state.update((sums.tobytes(), weights.tobytes(), np.array(sorted(seen), np.int64).tobytes(), done))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + patience_ms)

    return assemble


def _given(scan: int, t: int, first: int, sums: np.ndarray, weights: np.ndarray, complete: bool) -> pd.DataFrame:
    """The lines of a band that some tile covers; elements that none covers are null."""
    rows = np.flatnonzero((weights > 0).any(1))
    lines = [[s / w if w > 0 else None for s, w in zip(sums[r].tolist(), weights[r].tolist(), strict=True)] for r in rows]
    return pd.DataFrame({"scan": np.int32(scan), "t": np.int32(t), "z": (first + rows).astype(np.int32), "row": lines, "complete": complete})


def stitched(lines: DataFrame, tiles: DataFrame, half: int, late: str = "10 minutes", patience_seconds: int = 600, band: int = BAND) -> DataFrame:
    """(scan, t, z, x, v, complete) from a stream of tiles' lines (LINE): what mosaic.stitched() gives of all of them.

    A line that comes twice counts once; lines that the catalog lacks are left out, as are null rows. A band whose last line
    came ``patience_seconds`` before the watermark (``late`` behind the latest arrival) is given with complete = false.
    Lines that come after that are a band of their own, which is never complete.
    """
    catalog = expected(tiles, band)
    known = lines.withWatermark("arrived", late).where("row is not null")
    near = known.join(catalog, ["scan", "zi", "xi"]).where((F.col("z") < F.col("r_hi") - F.col("r_lo")) & (F.col("z") >= 0) & (F.floor((F.col("r_lo") + F.col("z")) / band) == F.col("band")) & (F.size("row") == F.col("c_hi") - F.col("c_lo")))
    ready = near.withColumn("second", (F.col("t") >= half).cast("int")).withColumn("t", (F.col("t") % half).cast("int"))
    found = ready.groupBy("scan", "t", "band").applyInPandasWithState(_assembler(1000 * patience_seconds, band), STITCHED, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("scan", "t", "z", F.posexplode("row").alias("x", "v"), "complete").where("v is not null")
