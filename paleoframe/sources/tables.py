"""Readers of summary files: substitution tables, length distributions, per-taxon damage, lengths and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lengths import normalised, normalised_by_all
from ..operators.profile import damage_summary, mismatch_long
from ..schema import CELLS, LENGTH_LIMIT, POSITIONS
from . import damage


def read_mismatch_table(spark: SparkSession, path: str) -> DataFrame:
    """end, dist and a column a cell, of a tab-separated table (plain or gzip) with a header of which only the place
    counts. Columns beyond the 16 counts are not read."""
    names = ["end", "pos", *CELLS]
    schema = ", ".join(f"{c} {'string' if c == 'end' else 'int' if c == 'pos' else 'double'}" for c in [*names, "freq_ct", "freq_ga"])
    rows = spark.read.csv(path, sep="\t", header=True, schema=schema, enforceSchema=True, quote="")
    return rows.where(F.col("pos").between(1, POSITIONS)).select("end", (F.col("pos") - 1).alias("dist"), *CELLS)


def read_mismatch_counts(spark: SparkSession, path: str) -> DataFrame:
    """end, dist, ref, read, n."""
    return mismatch_long(read_mismatch_table(spark, path))


def read_lengths(spark: SparkSession, path: str, limit: int = LENGTH_LIMIT, compat: bool = False) -> DataFrame:
    """length, freq of a file of length and count or frequency by white space. Lengths up to the limit count.

    compat: in file order, rows before the last one under the limit are kept whatever their length.
    """
    parts = F.split(F.trim("value"), r"[\t ]+")
    rows = spark.read.text(path).where("trim(value) <> ''").select(parts[0].cast("int").alias("length"), parts[1].cast("double").alias("weight"))
    if not compat:
        return normalised(rows, limit)
    rows = rows.withColumn("_at", F.monotonically_increasing_id())  # the file is a small one
    everything = Window.partitionBy(F.lit(0))
    under = F.col("length") < limit
    rows = rows.withColumn("_last", F.max(F.when(under, F.col("_at"))).over(everything)).withColumn("_sum", F.sum(F.when(under, F.col("weight"))).over(everything))
    return rows.where("_at <= _last").select("length", (F.col("weight") / F.col("_sum")).alias("freq"))


def read_rlens(spark: SparkSession, path: str, limit: int = LENGTH_LIMIT) -> DataFrame:
    """length, freq of a two-line table ``id  rlen30 ...``: names lose their first four characters; shares are of all
    lengths, also of those that are left out."""
    lines = [r["value"] for r in spark.read.text(path).limit(2).collect()]
    if len(lines) < 2:
        raise ValueError("a length table has two lines")
    names, values = (x.rstrip("\n").split("\t")[1:] for x in lines)
    rows = [(int(n[4:]), float(v)) for n, v in zip(names, values, strict=False) if n]
    return normalised_by_all(spark.createDataFrame(rows, "length int, weight double"), limit)


def read_bdamage(spark: SparkSession, path: str, kind: str = "f4", split: int = damage.SPLIT_BYTES) -> DataFrame:
    """BDAMAGE rows of a file or of a folder of them; taxa without reads are left out."""
    return damage.read(spark, path, kind, split).where("nreads > 0")


def bdamage_counts(rows: DataFrame, positions: int = POSITIONS) -> DataFrame:
    """taxid, end, dist, ref, read, n for the first positions of each end."""
    parts = [
        rows.select("taxid", F.lit(end).alias("end"), F.posexplode(c).alias("i", "n")) for end, c in (("5'", "fw"), ("3'", "bw"))
    ]
    cell = F.col("i") % 16
    return parts[0].unionByName(parts[1]).where(F.col("i") < 16 * positions).select(
        "taxid", "end", F.floor(F.col("i") / 16).cast("int").alias("dist"), F.floor(cell / 4).cast("int").alias("ref"), (cell % 4).cast("int").alias("read"), "n"
    )


def bdamage_summary(rows: DataFrame, positions: int) -> DataFrame:
    """damage_summary of BDAMAGE rows, at the first positions; a record that stores fewer is an error."""
    short = F.raise_error(F.concat(F.lit(f"{positions} positions asked for, stored are "), F.col("positions").cast("string")))
    checked = rows.withColumn("fw", F.when(F.col("positions") < positions, short.cast("array<double>")).otherwise(F.col("fw")))
    n = rows.select("taxid", F.col("nreads").alias("n_reads"))
    return damage_summary(bdamage_counts(checked, positions), n, "taxid", positions)


def read_taxon_stats(spark: SparkSession, path: str) -> DataFrame:
    """taxid, nreads, mean and variance of lengths and of GC shares, with or without a header; text NA is null."""
    p = F.split(F.trim("value"), r"\s+")
    names = ["nreads", "mean_len", "var_len", "mean_gc", "var_gc"]
    rows = spark.read.text(path).where("trim(value) <> ''").where(~F.startswith("value", F.lit("taxid")))
    kinds = ["long", *["double"] * 4]
    return rows.select(p[0].alias("taxid"), *[F.nullif(p[i + 1], F.lit("NA")).cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))])


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    p = F.split("value", r"[\t ]+")
    return spark.read.text(path).where("trim(value) <> ''").select(p[0].alias("chrom"), p[1].cast("long").alias("start"), p[2].cast("long").alias("end"))
