"""Fragment-length distributions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import LENGTH_LIMIT, MIN_LENGTH

def _all():
    """Over tables of one row a length."""
    return Window.partitionBy(F.lit(0))


def length_histogram(reads: DataFrame) -> DataFrame:
    return reads.groupBy("length").agg(F.count(F.lit(1)).alias("n"))


def gap_filled(hist: DataFrame) -> DataFrame:
    """length, n, freq with a row for each length from the shortest to the longest."""
    span = hist.agg(F.min("length").alias("a"), F.max("length").alias("b")).where("a IS NOT NULL")
    every = span.select(F.explode(F.sequence("a", "b")).alias("length"))
    full = every.join(hist, "length", "left").select("length", F.coalesce("n", F.lit(0)).alias("n"))
    return full.withColumn("freq", F.col("n") / F.sum("n").over(_all()))


def shortest(reads: DataFrame) -> DataFrame:
    """len_min: the shortest length, at least MIN_LENGTH."""
    return reads.agg(F.greatest(F.min("length"), F.lit(MIN_LENGTH)).alias("len_min"))


def normalised(weights: DataFrame, limit: int = LENGTH_LIMIT) -> DataFrame:
    """length, freq of (length, weight) rows under the limit; they add up to one."""
    kept = weights.where(F.col("length") < limit)
    return kept.select("length", (F.col("weight") / F.sum("weight").over(_all())).alias("freq"))


def normalised_by_all(weights: DataFrame, limit: int = LENGTH_LIMIT) -> DataFrame:
    """length, freq of the lengths in (0, limit), as shares of all lengths."""
    shares = weights.select("length", (F.col("weight") / F.sum("weight").over(_all())).alias("freq"))
    return shares.where((F.col("length") > 0) & (F.col("length") < limit))


def rebin(lengths: list[float], freqs: list[float], bins: int = -1) -> tuple[list[float], list[float]]:
    """Lengths dealt over ``bins`` bins of equal, possibly fractional width: bin centres and frequencies.

    -1 bins, or as many as there are lengths, change nothing. A length on a border is shared in proportion.
    """
    if bins <= 0 or bins >= len(lengths):
        return list(lengths), list(freqs)
    low, width = min(lengths) - 0.5, (max(lengths) - min(lengths) + 1) / bins
    out = [0.0] * bins
    for x, f in zip(lengths, freqs, strict=True):
        a, b = (x - 0.5 - low) / width, (x + 0.5 - low) / width
        for k in range(max(0, math.floor(a)), min(bins, math.ceil(b))):
            out[k] += f * (min(b, k + 1) - max(a, k)) / (b - a)
    return [low + (k + 0.5) * width for k in range(bins)], out
