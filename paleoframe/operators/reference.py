"""Reference sequences as chunks, and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1 << 16


def fetch(wanted: DataFrame, chunks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """wanted (key, rname, begin, end; 0-based, end included) with ``bases``, the reference there, cut at its end.

    chunks: rname, chunk_id, seq of ``chunk`` bases each. An equi-join on the chunk; a range over several chunks is put
    together from its parts. A range without any reference has no row.
    """
    first, last = F.floor(F.col("begin") / chunk), F.floor(F.col("end") / chunk)
    parts = wanted.withColumn("chunk_id", F.explode(F.sequence(first, last)))
    base = F.col("chunk_id") * chunk
    a, b = F.greatest(F.col("begin") - base, F.lit(0)), F.least(F.col("end") - base, F.lit(chunk - 1))
    cut = F.substring("seq", (a + 1).cast("int"), (b - a + 1).cast("int"))
    joined = parts.join(chunks, ["rname", "chunk_id"]).select("key", "rname", "begin", "end", "chunk_id", cut.alias("part"))
    return joined.groupBy("key", "rname", "begin", "end").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_id", "part"))), lambda x: x["part"]), "").alias("bases")
    )


def within(reads: DataFrame, bed: DataFrame, bin_size: int = 1 << 14) -> DataFrame:
    """Reads (rname, pos) that begin inside an interval of bed (chrom, start, end; start excluded, end included, as
    1-based positions). Intervals are listed under the bins they touch, so this is an equi-join at any size."""
    bins = bed.select(
        F.col("chrom").alias("rname"), F.col("start").alias("_a"), F.col("end").alias("_b"),
        F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.col("end") / bin_size))).alias("_bin"),
    )
    r = reads.withColumn("_bin", F.floor(F.col("pos") / bin_size))
    near = (r["rname"] == bins["rname"]) & (r["_bin"] == bins["_bin"]) & (r["pos"] >= bins["_a"]) & (r["pos"] < bins["_b"])
    return r.join(bins, near, "left_semi").drop("_bin")


def windows(bed: DataFrame, size: int = 1 << 14) -> list[tuple[str, int, int]]:
    """(chrom, begin, end), 0-based with the end out: runs of neighbouring windows that intervals of bed touch, for a source
    that reads regions. As many as the reference has windows at most, however many intervals there are."""
    touched = bed.where("start < end").select("chrom", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))).alias("w")).distinct()
    run = F.col("w") - F.row_number().over(Window.partitionBy("chrom").orderBy("w"))
    runs = touched.withColumn("run", run).groupBy("chrom", "run").agg(F.min("w").alias("a"), F.max("w").alias("b"))
    return sorted((r["chrom"], int(r["a"]) * size, (int(r["b"]) + 1) * size) for r in runs.collect())
