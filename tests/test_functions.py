import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions.scalar import clip, frequency, sinc
from lamina.operators.geometry import magnification, mm_to_px, px_to_mm


def test_scalar_functions(spark):
    rows = spark.range(7).select(F.col("id").alias("k"), sinc(F.col("id") / 2).alias("s"), clip(F.col("id").cast("double"), 1.0, 4.5).alias("c"), frequency(F.col("id"), 7, 0.5).alias("f")).orderBy("k").toPandas()
    assert np.allclose(rows.s, np.sinc(np.arange(7) / 2)) and np.allclose(rows.c, np.clip(np.arange(7), 1, 4.5)) and np.allclose(rows.f, np.fft.fftfreq(7, 0.5))


def test_units(spark):
    row = spark.range(1).select(px_to_mm(F.lit(100.0), F.lit(1.38)).alias("mm"), mm_to_px(F.lit(0.138), F.lit(1.38)).alias("px"), magnification(F.lit(2.0), F.lit(1.0)).alias("m")).first()
    assert (row.mm, row.px, row.m) == (pytest.approx(0.138), pytest.approx(100.0), 1.5)
