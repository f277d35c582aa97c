"""Spacing statistics: the mean of the fullest bin of a histogram, and the mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def peak_average(values: DataFrame, keys: list[str], value: str, bin_size: float = 1.0, at_least_zero: bool = True) -> DataFrame:
    """keys, peak: bins are min(bin_size, ceil(max)) wide (bin_size where the maximum is 0); of equally full bins the lowest wins.

    Partial aggregates only: one pass for the maximum, one for the bins, joined on the keys."""
    v = values.where(F.col(value) >= 0) if at_least_zero else values
    top = v.groupBy(*keys).agg(F.ceil(F.max(value)).alias("_max"))
    top = top.select(*keys, F.when(F.col("_max") == 0, F.lit(float(bin_size))).otherwise(F.col("_max")).cast("double").alias("_max"))
    top = top.select(*keys, F.least(F.lit(float(bin_size)), "_max").alias("_bin"), F.col("_max"))
    binned = v.join(top, keys).withColumn("_i", F.least(F.floor(F.col(value) / F.col("_bin")), F.ceil(F.col("_max") / F.col("_bin"))))
    bins = binned.groupBy(*keys, "_i").agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_mean"))
    best = F.max_by("_mean", F.struct("_n", -F.col("_i")))
    return bins.groupBy(*keys).agg(best.alias("peak"))


def mode(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, mode: the most frequent value; null where two share the first place."""
    counts = values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(*keys).orderBy(F.col("_n").desc())
    first = counts.select(*keys, value, F.rank().over(w).alias("_k")).where("_k = 1")
    return first.groupBy(*keys).agg(F.when(F.count(F.lit(1)) == 1, F.max(value)).alias("mode"))
