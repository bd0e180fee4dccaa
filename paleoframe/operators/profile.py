"""Substitution counts by distance from the molecule's ends, and the profile that the model is fitted to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import distances, is_reverse
from ..schema import CELLS, NO_QUALITY, POSITIONS, Options
from .reads import eligible, end_places


def _by_end(bases: DataFrame, by: tuple[str, ...], total: Column, name: str) -> DataFrame:
    """(by,) end, dist, ref, read and the sum of ``total`` over the bases near to each end.

    Bases are summed by both distances first, which are equal beyond the positions looked at, and only the sums are
    listed under the two ends: a task sends 480 rows a group, and no row is made for each base and end.
    """
    near = lambda c: F.least(F.col(c), F.lit(POSITIONS)).alias(c)
    part = bases.select(*by, near("dist5"), near("dist3"), "ref", "read", total.alias("_v"))
    if not bases.isStreaming:  # a stream keeps one state, that of the last sum
        part = part.groupBy(*by, "dist5", "dist3", "ref", "read").agg(F.sum("_v").alias("_v"))
    return _listed(part, by, name)


def _listed(part: DataFrame, by: tuple[str, ...], name: str) -> DataFrame:
    """Sums by both distances, listed under each end that is near."""
    at = F.explode(F.array(F.struct(F.lit("5'").alias("end"), F.col("dist5").alias("dist")), F.struct(F.lit("3'").alias("end"), F.col("dist3").alias("dist"))))
    rows = part.select(*by, "ref", "read", "_v", at.alias("at")).select(*by, "at.end", "at.dist", "ref", "read", "_v")
    return rows.where(F.col("dist") < POSITIONS).groupBy(*by, "end", "dist", "ref", "read").agg(F.sum("_v").alias(name))


#: A row of read_summary: bases by both distances and their codes, or (dist3 under 0) reads by length, which is dist5.
SUMMARY = "dist5 int, dist3 int, ref int, read int, n long, lacking long"


def read_summary(aligned: DataFrame, o: Options = Options()) -> DataFrame:
    """SUMMARY of all eligible reads: what a fit needs to know about them, in one pass and one aggregate.

    A read is exploded into its end bases and one row for itself, which counts its length and whether its qualities are
    missing. However many reads there are, the result has at most 16 x 16 x 16 rows of bases and one for each length.
    """
    places = F.explode(F.concat(F.array(F.lit(-1)), end_places()))
    rows = eligible(aligned, o).where("length > 0").select("flag", "length", "ref", "read", "qual", places.alias("cycle"))
    own, at = F.col("cycle") < 0, F.greatest(F.col("cycle"), F.lit(0)) + 1
    rows = rows.withColumns({c: F.try_element_at(c, at) for c in ("ref", "read", "qual")})
    keep = (F.col("ref") < 4) & (F.col("read") < 4)
    if o.min_quality:
        keep &= F.col("qual") >= o.min_quality
    rows = rows.where(own | keep)  # before anything is turned
    near = [F.least(d, F.lit(POSITIONS)) for d in distances("cycle", "length", "flag")]
    code = lambda c: F.when(own, -1).when(is_reverse("flag"), 3 - F.col(c)).otherwise(F.col(c)).cast("int").alias(c)
    part = rows.select(
        F.when(own, F.col("length")).otherwise(near[0]).cast("int").alias("dist5"), F.when(own, -1).otherwise(near[1]).cast("int").alias("dist3"),
        code("ref"), code("read"), (own & (F.col("qual") == NO_QUALITY)).cast("long").alias("lacks"),
    )
    return part.groupBy("dist5", "dist3", "ref", "read").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("lacks"), F.lit(0)).alias("lacking"))


def summary_counts(summary: DataFrame) -> DataFrame:
    """mismatch_counts of a read_summary."""
    return _listed(summary.where("dist3 >= 0").select("dist5", "dist3", "ref", "read", F.col("n").alias("_v")), (), "n")


def summary_lengths(summary: DataFrame) -> DataFrame:
    """length_histogram of a read_summary."""
    return summary.where("dist3 < 0").select(F.col("dist5").alias("length"), "n")


def mismatch_counts(bases: DataFrame, *by: str) -> DataFrame:
    """(by,) end, dist, ref, read, n. Partial counts are made before the shuffle."""
    return _by_end(bases, by, F.lit(1).cast("long"), "n")


def weighted_counts(bases: DataFrame, reads: DataFrame, by: str, weight: str) -> DataFrame:
    """As mismatch_counts, with summed weights and the number of reads of the class (rows of ``reads``)."""
    cells = _by_end(bases, (by,), F.col(weight), "w")
    return cells.join(reads.groupBy(by).agg(F.count(F.lit(1)).alias("n_reads")), by)


def mismatch_wide(counts: DataFrame, *by: str, value: str = "n") -> DataFrame:
    """(by,) end, dist and a column a cell (AA, AC, ... TT; reference base first); every position, zeros included."""
    cell = F.col("ref") * 4 + F.col("read")
    sums = [F.coalesce(F.sum(F.when(cell == k, F.col(value))), F.lit(0)).alias(c) for k, c in enumerate(CELLS)]
    return counts.groupBy(*by, "end", "dist").agg(*sums)


def mismatch_long(wide: DataFrame, *by: str) -> DataFrame:
    """The inverse of mismatch_wide."""
    pairs = ", ".join(f"{k // 4}, {k % 4}, {c}" for k, c in enumerate(CELLS))
    return wide.selectExpr(*by, "end", "dist", f"stack(16, {pairs}) AS (ref, read, n)")


def substitution_rates(counts: DataFrame, *by: str) -> DataFrame:
    """(by,) end, dist, ref, read, n, rate: n over the total of its reference base (1 where that is 0)."""
    w = Window.partitionBy(*by, "end", "dist", "ref")
    total = F.sum("n").over(w)
    return counts.withColumn("rate", F.greatest(F.lit(0.0), F.col("n") / F.coalesce(F.nullif(total, F.lit(0)), F.lit(1))))


def profile(wide: DataFrame, *by: str, drop_tt: bool = False) -> DataFrame:
    """(by,) idx, freq_ct, freq_ga, scale_ct, scale_ga, seq_err.

    idx 0..14: 5' C to T and 3' G to A (the primary signals) by distance; 29 - distance: 3' C to T and 5' G to A.
    Scales are row totals of reference C or G over their common maximum. Ratios of empty rows are null.
    drop_tt leaves out the T-to-T cell, as tables of per-taxon damage files did.
    """
    cell = {c: F.col(c).cast("double") for c in CELLS}
    if drop_tt:
        cell["TT"] = F.lit(0.0)
    total = lambda r: sum((cell[r + x] for x in "CGT"), cell[r + "A"])
    same = cell["AA"] + cell["TT"]
    five = F.col("end") == "5'"
    idx = F.when(five, F.col("dist"))
    rest = wide.select(
        *by,
        "end",
        "dist",
        total("C").alias("c"),
        total("G").alias("g"),
        F.try_divide(cell["CT"], total("C")).alias("ct"),
        F.try_divide(cell["GA"], total("G")).alias("ga"),
        (1 - F.try_divide(same, total("A") + total("T"))).alias("err"),
    )
    # a position of either end gives one idx to each of the two signals
    folded = F.array(
        F.struct(
            F.coalesce(idx, 2 * POSITIONS - 1 - F.col("dist")).cast("int").alias("idx"),
            F.col("ct").alias("freq_ct"), F.col("c").alias("scale_ct"), F.col("err").alias("seq_err"),
            F.lit(None).cast("double").alias("freq_ga"), F.lit(None).cast("double").alias("scale_ga"),
        ),
        F.struct(
            F.when(five, 2 * POSITIONS - 1 - F.col("dist")).otherwise(F.col("dist")).cast("int").alias("idx"),
            F.lit(None).cast("double").alias("freq_ct"), F.lit(None).cast("double").alias("scale_ct"), F.lit(None).cast("double").alias("seq_err"),
            F.col("ga").alias("freq_ga"), F.col("g").alias("scale_ga"),
        ),
    )
    names = ["freq_ct", "freq_ga", "scale_ct", "scale_ga", "seq_err"]
    out = rest.select(*by, F.explode(folded).alias("x")).select(*by, "x.*").groupBy(*by, "idx").agg(*[F.max(c).alias(c) for c in names])
    top = F.max(F.greatest("scale_ct", "scale_ga")).over(Window.partitionBy(*(by or (F.lit(0),))))
    return out.withColumns({"max_all": top}).withColumns({c: F.try_divide(F.col(c), F.col("max_all")) for c in ("scale_ct", "scale_ga")})


def damage_summary(counts: DataFrame, n_reads: DataFrame, by: str, positions: int) -> DataFrame:
    """by, dist, n_reads and, each times n_reads: the 5' C to T rate, the 3' G to A rate, and a tenth of the sum of all
    other substitution rates of both ends."""
    r = substitution_rates(counts.where(F.col("dist") < positions), by)
    ct = (F.col("end") == "5'") & (F.col("ref") == 1) & (F.col("read") == 3)
    ga = (F.col("end") == "3'") & (F.col("ref") == 2) & (F.col("read") == 0)
    rest = (F.col("ref") != F.col("read")) & ~ct & ~ga
    pick = lambda x: F.sum(F.when(x, F.col("rate")).otherwise(0.0))
    sums = r.groupBy(by, "dist").agg(pick(ct).alias("ct"), pick(ga).alias("ga"), (pick(rest) / 10).alias("other"))
    return sums.join(n_reads, by).select(by, "dist", "n_reads", *[(F.col(c) * F.col("n_reads")).alias(c) for c in ("ct", "ga", "other")])
