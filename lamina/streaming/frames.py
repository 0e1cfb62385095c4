"""Frames as they arrive: the operators on single projections, over a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators.wave import intensity, transmitted

FRAME = "t int, z int, x int, v double, arrived timestamp"


def arriving(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(FRAME).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def intensities(frames: DataFrame, norm: float) -> DataFrame:
    """Transmitted intensity of each element: stateless, so a batch of frames gives what all frames together give."""
    waves = transmitted(frames, norm)
    return waves.select("t", "z", "x", intensity(F.col("re"), F.col("im")).alias("v"), "arrived")


def frame_statistics(frames: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Per window of arrival: elements, least, most and sum; elements later than ``late`` are left out of closed windows."""
    return frames.withWatermark("arrived", late).groupBy(F.window("arrived", window)).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.sum("v").alias("total"))
