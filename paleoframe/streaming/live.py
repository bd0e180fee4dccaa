"""Live profiles: the counts are sums, so a stream of aligned reads keeps them without watermarks or late data."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.profile import mismatch_counts
from ..operators.reads import eligible, end_bases
from ..schema import Options


def live_counts(stream: DataFrame, o: Options = Options()) -> DataFrame:
    """end, dist, ref, read, n of a streaming DataFrame of aligned reads; write it in complete or update mode."""
    return mismatch_counts(end_bases(eligible(stream, o)))


def live_lengths(stream: DataFrame, o: Options = Options()) -> DataFrame:
    return eligible(stream, o).groupBy("length").count().withColumnRenamed("count", "n")
