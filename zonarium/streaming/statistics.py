"""Running zonal statistics of pixels that arrive as a stream.

Means, variances, deviations and weights are functions of sums, so a streaming aggregate keeps one row of sums for each
zone and band as its state and gives the quantities of all pixels so far. Quantiles and distributions need all values
and are left to tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonarium.operators.statistics import KEYS, Units, _integral, one_pass
from zonarium.plans.spec import parse


def running_statistics(pixels: DataFrame, quantities: list[str] = (), centroid_quantities: list[str] = (), units: Units = Units(), ignore_values: tuple = ()) -> DataFrame:
    """zone_id, band_name and a column for each quantity, for the output modes update and complete."""
    asked = parse(quantities, centroid_quantities)
    if any(q.family not in ("Mean", "Var", "Std", "Weight") for q in asked):
        raise ValueError("a stream has means, variances, deviations and weights only")
    if any(q.family in ("Var", "Std") for q in asked) and not _integral(pixels, "value", "coverage", "weight"):
        raise ValueError("variances of a stream need integers in units, so that their sums are exact")
    return one_pass(pixels, asked, units, ignore_values)


def windowed_weights(pixels: DataFrame, time: str, length: str, late: str) -> DataFrame:
    """window, zone_id, band_name, weight, pixels: sums of coverage times weight by event time, final once it is past `late`."""
    timed = pixels.withWatermark(time, late)
    return timed.groupBy(F.window(time, length).alias("window"), *KEYS).agg(F.sum(F.col("coverage") * F.col("weight")).alias("weight"), F.count("*").alias("pixels"))
