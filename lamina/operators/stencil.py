"""Stencils on long-form stacks: whole lines meet their neighbours, and windows slide over them in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lines import exploded


def neighbour_medians(values: DataFrame, window: int, sizes: dict[str, int]) -> DataFrame:
    """Adds ``median`` of the window x window elements around each one, axes mirrored at their ends (the end sample twice).

    sizes has the two axes. Lines along the second one are gathered and sent to the ``window`` lines that they are neighbours
    of; indices beyond an end come from lines within half a window of it, which are therefore sent there as well. A task holds
    some lines and their neighbours.
    """
    (axis, n), (along, width) = sizes.items()
    half = window // 2
    keys = [c for c in values.columns if c not in ("v", axis, along)]
    at = F.col(axis)
    steps = F.sequence(F.lit(-half), F.lit(half))
    none = F.array().cast("array<int>")
    mirrored = F.when(at < half, F.transform(steps, lambda k: F.when(-1 - at + k >= 0, -1 - at + k))).otherwise(none)
    beyond = F.when(at >= n - half, F.transform(steps, lambda k: F.when(2 * n - 1 - at + k < n, 2 * n - 1 - at + k))).otherwise(none)
    lines = values.groupBy(*keys, axis).agg(F.array_sort(F.collect_list(F.struct(along, "v"))).alias("_l")).select(*keys, axis, F.col("_l.v").alias("row"))
    sent = lines.withColumn("_to", F.explode(F.concat(F.transform(steps, lambda k: at + k), mirrored, beyond))).where((F.col("_to") >= 0) & (F.col("_to") < n))
    met = sent.groupBy(*keys, F.col("_to").alias(axis)).agg(F.collect_list("row").alias("rows"), F.first(F.when(F.col("_to") == at, F.col("row")), ignorenulls=True).alias("v"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in met.select(*keys, axis).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for rows in batch["rows"]:
                wide = np.pad(np.stack(rows), ((0, 0), (half, half)), mode="symmetric")
                windows = np.lib.stride_tricks.sliding_window_view(wide, window, axis=1)  # line, place, step
                found.append(np.median(windows.transpose(1, 0, 2).reshape(windows.shape[1], -1), axis=1))
            yield batch[[*keys, axis, "v"]].assign(median=found)

    return exploded(met.mapInPandas(run, f"{kinds}, v array<double>, median array<double>"), [*keys, axis], along, ("v", "median"))


def dezingered(values: DataFrame, window: int, threshold: float, sizes: dict[str, int]) -> DataFrame:
    """Bright outliers replaced: an element that exceeds its neighbourhood's median by more than the threshold becomes it."""
    if window <= 0:
        return values
    near = neighbour_medians(values, window, sizes)
    return near.withColumn("v", F.when(F.col("v") - F.col("median") > threshold, F.col("median")).otherwise(F.col("v"))).drop("median")


def flat_corrected(data: DataFrame, flat: DataFrame, dark: DataFrame, keys: tuple[str, ...] = ("z", "x")) -> DataFrame:
    """(v - dark) / (flat (1 + 1e-5) - dark) with the fields' means over their frames. Fields have (keys, v) and a frame each row;
    keys name a tile as well where each has its own fields."""
    mean = lambda field, name: field.groupBy(*keys).agg(F.avg("v").alias(name))
    fields = mean(flat, "_flat").join(mean(dark, "_dark"), list(keys))
    return data.join(fields, list(keys)).withColumn("v", (F.col("v") - F.col("_dark")) / (F.col("_flat") * (1 + 1e-5) - F.col("_dark"))).drop("_flat", "_dark")
