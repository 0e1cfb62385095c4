"""Statistics of arrays: aggregates that are partly computed in each task before a small shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.sources import store


def described(values: DataFrame, *keys: str, value: str = "v") -> DataFrame:
    """Least, most, mean (0 of nothing), count, and whether any is NaN, overall or per key; NaN counts in the mean only."""
    v = F.col(value)
    real = F.when(~F.isnan(v), v)
    aggregates = [F.min(real).alias("least"), F.max(real).alias("most"), (F.coalesce(F.sum(v), F.lit(0.0)) / F.greatest(F.count(v), F.lit(1))).alias("mean"), F.count(v).alias("n"), F.coalesce(F.max(F.isnan(v)), F.lit(False)).alias("has_nan")]
    return values.groupBy(*keys).agg(*aggregates)


def axis_mean(values: DataFrame, axis: str, value: str = "v") -> DataFrame:
    return values.groupBy(*[c for c in values.columns if c not in (axis, value)]).agg(F.avg(value).alias(value))


#: Ranges that a round of counting cuts each open range into.
CUTS = 1024


def order_statistics(values: DataFrame, ranks: DataFrame, keys: tuple[str, ...], value: str = "v") -> DataFrame:
    """ranks (keys, rank from 0) with ``value``, the rank-th of each key's values in ascending order; exact, for any distribution.

    Ranges are narrowed in rounds: the rows of a range are counted in CUTS parts of it, with the least and greatest value of
    each; the part that holds the rank is the next range, until its ends are one value. Both ends of a range are parts of their
    own, so each round narrows it. Counts are summed before the shuffle, so a key may hold any share of the rows, and only rows
    of open ranges are counted again. A round's state, a row for each key and rank, is written to the shared folder.
    """
    same = lambda a, b: reduce(Column.__and__, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys], F.lit(True))
    own = values.select(*keys, F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    ends = own.groupBy(*keys).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    state = _kept(ranks.alias("r").join(ends.alias("e"), same("r", "e")).select(*[f"r.{k}" for k in keys], "rank", "low", "high", F.lit(0).cast("long").alias("before")))
    rounds = 0
    while state.where("low < high").limit(1).count():
        open_ = state.where("low < high").select(*keys, "low", "high").distinct()
        # Parts of equal width, and in every other round of equal ratios, for values of all magnitudes. Halves, so that the
        # difference of two large values is finite; between infinite ends all is one part.
        at = (lambda c: F.signum(c) * F.coalesce(F.log(F.abs(c)) + 746, F.lit(0.0))) if rounds % 2 else (lambda c: F.col(c) / 2)
        share = (at("v") - at("low")) / (at("high") - at("low"))
        rounds += 1
        inner = F.least(F.lit(CUTS - 1), F.greatest(F.lit(0), F.coalesce(F.floor(F.nanvl(share, F.lit(0.0)) * CUTS), F.lit(0))))
        part = F.when(F.col("v") == F.col("low"), -1).when(F.col("v") == F.col("high"), CUTS).otherwise(inner).cast("int")
        counted = (
            own.alias("o").join(open_.alias("s"), same("o", "s") & (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))).withColumn("part", part)
            .groupBy(*[F.col(f"s.{k}").alias(k) for k in keys], "low", "high", "part").agg(F.count("*").alias("n"), F.min("v").alias("first"), F.max("v").alias("last"))
        )
        # At most CUTS + 2 rows for a range.
        by = Window.partitionBy(*keys, "low", "high").orderBy("part")
        sums = counted.withColumn("upto", F.sum("n").over(by)).withColumnsRenamed({"low": "_low", "high": "_high"})
        place = F.col("rank") - F.col("before")
        hit = (
            state.where("low < high").alias("t").join(sums.alias("c"), same("t", "c") & (F.col("low") == F.col("_low")) & (F.col("high") == F.col("_high")) & (place < F.col("upto")) & (place >= F.col("upto") - F.col("n")))
            .select(*[F.col(f"t.{k}").alias(k) for k in keys], "rank", F.col("first").alias("low"), F.col("last").alias("high"), (F.col("before") + F.col("upto") - F.col("n")).alias("before"))
        )
        state = _kept(state.where("low >= high").unionByName(hit))
    return state.select(*keys, "rank", F.col("low").alias(value))


def _kept(df: DataFrame) -> DataFrame:
    path = store.scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clip_range(values: DataFrame, low: float = 0.01, high: float = 0.99, *keys: str, value: str = "v") -> DataFrame:
    """The percentiles, interpolated, that a display is clipped at; nulls and NaN don't count. No task holds a key's values."""
    counts = _kept(values.where(F.col(value).isNotNull() & ~F.isnan(F.col(value))).groupBy(*keys).agg(F.count("*").alias("n")))
    places = [p * (F.col("n") - 1) for p in (low, high)]
    ranks = counts.where("n > 0").select(*keys, F.explode(F.array_distinct(F.array(*[f(p).cast("long") for p in places for f in (F.floor, F.ceil)]))).alias("rank"))
    found = order_statistics(values, ranks, keys, value)
    one = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", value))).alias("_v"))  # four entries at most
    same = reduce(Column.__and__, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], F.lit(True))
    at = lambda p: (F.ceil(p).cast("long"), F.floor(p).cast("long"))
    mean = lambda p: F.when(at(p)[0] == at(p)[1], F.col("_v")[at(p)[1]]).otherwise((at(p)[0] - p) * F.col("_v")[at(p)[1]] + (p - at(p)[1]) * F.col("_v")[at(p)[0]])
    return counts.alias("a").join(one.alias("b"), same).select(*[F.col(f"a.{k}").alias(k) for k in keys], mean(places[0]).alias("low"), mean(places[1]).alias("high"))


def errors(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Of b against a: largest difference over largest value, the l2 error relative to a, and the inner product."""
    both = a.withColumnRenamed("v", "_a").join(b.withColumnRenamed("v", "_b"), list(keys))
    d = F.col("_a") - F.col("_b")
    return both.agg((F.max(F.abs(d)) / F.max(F.abs("_a"))).alias("rel_max"), (F.sqrt(F.sum(d * d)) / F.sqrt(F.sum(F.col("_a") * F.col("_a")))).alias("rel_l2"), F.sum(F.col("_a") * F.col("_b")).alias("inner"))


def throughput(tasks: DataFrame, *keys: str) -> DataFrame:
    """From tasks (bytes, seconds): all bytes over the longest time, and the slowest and fastest task's rate."""
    rate = F.col("bytes") / F.col("seconds")
    return tasks.groupBy(*keys).agg((F.sum("bytes") / F.max("seconds")).alias("rate"), F.min(rate).alias("slowest"), F.max(rate).alias("fastest"))


def human_bytes(n: Column) -> Column:
    """A size with one decimal in the largest unit of 1024 that keeps it at 1 or more."""
    text = F.format_string("%.1f B", F.bround(n.cast("double"), 1))
    for power, unit in enumerate(("KB", "MB", "GB", "TB", "PB"), 1):
        text = F.when(n >= 1024**power, F.format_string(f"%.1f {unit}", F.bround(n / 1024.0**power, 1))).otherwise(text)
    return text
