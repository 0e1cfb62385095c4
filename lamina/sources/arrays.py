"""Foreign array files, page by page: multi-page TIFF and HDF5. Their libraries are optional, and asked for when a file is read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def _library(name: str):
    try:
        return __import__(name)
    except ImportError as e:
        raise ImportError(f"reading this kind of file needs the library {name} on every machine; Parquet needs none") from e


def pages(spark: SparkSession, path: str, count: int, kind: str, dataset: str = "/exchange/data") -> DataFrame:
    """(z, y, row) of a file that all machines can open: a task reads some of its ``count`` pages."""
    _library({"tiff": "tifffile", "hdf5": "h5py"}[kind])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for z in batch["id"]:
                if kind == "tiff":
                    page = _library("tifffile").imread(path, key=int(z))
                else:
                    with _library("h5py").File(path) as f:
                        page = f[dataset][int(z)]
                yield pd.DataFrame({"z": int(z), "y": np.arange(len(page)), "row": list(page.astype(np.float32))})

    return spark.range(count).mapInPandas(run, "z int, y int, row array<float>")
