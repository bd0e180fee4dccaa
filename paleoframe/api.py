"""Fit, recalibrate and score: the three things that a user runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import lengths as OL
from .operators import profile as OP
from .operators import reads as OR
from .operators import reference as OREF
from .operators import score as OS
from .operators.alignment import aligned as rebuild
from .operators.alignment import span
from .plans import fit as PF
from .plans import mixture as PM
from .schema import MIN_LENGTH, Options
from .sources import tables


@dataclass(frozen=True)
class Fitted:
    fit: PF.Fit
    wide: DataFrame
    lengths: DataFrame
    len_min: int = MIN_LENGTH
    n_reads: int | None = None
    lacking: int | None = None  # reads without qualities, whose bases count but are left out of scores


def align(reads: DataFrame, chunks: DataFrame | None = None, o: Options = Options()) -> DataFrame:
    """ALIGNED rows of READS rows: from MD tags, or from the reference's chunks where these are given. Flags and
    lengths are filtered before anything is rebuilt."""
    own = reads.withColumn("length", F.length("seq"))
    own = OR.reject_unmapped(OR.eligible(own, o).withColumn("read_id", F.xxhash64("qname", "flag", "rname", "pos", "cigar")))
    if chunks is None:
        return rebuild(own.withColumn("md", F.col("tags")["MD"]), "md", o.compat)
    # each range is fetched once, however many reads lie in it; a read without reference is an error, never a lost row
    own = own.withColumns({"_begin": F.col("pos"), "_end": F.col("pos") + span("cigar") - 1})
    wanted = own.select(F.lit(0).alias("key"), "rname", F.col("_begin").alias("begin"), F.col("_end").alias("end")).distinct()
    found = OREF.fetch(wanted, chunks).select(F.col("rname").alias("_rname"), F.col("begin").alias("_b"), F.col("end").alias("_e"), "bases")
    joined = own.join(found, (F.col("rname") == F.col("_rname")) & (F.col("_begin") == F.col("_b")) & (F.col("_end") == F.col("_e")), "left")
    missing = F.raise_error(F.concat(F.lit("no reference at "), F.col("rname"), F.lit(":"), F.col("_begin").cast("string"))).cast("string")
    return rebuild(joined.withColumn("bases", F.coalesce("bases", missing)).drop("_begin", "_end", "_rname", "_b", "_e"), "bases", o.compat)


def fit_reads(aligned: DataFrame, o: Options = Options(), lengths: DataFrame | None = None) -> Fitted:
    """Fit to aligned reads, in one pass over them; lengths (length, freq) replaces the reads' own distribution.

    Of the pass at most some 4,600 rows reach the driver; everything after it is computed from these.
    """
    spark = aligned.sparkSession
    rows = OP.read_summary(aligned, o).collect()
    summary = spark.createDataFrame(rows, OP.SUMMARY)
    counts, hist = OP.summary_counts(summary), OP.summary_lengths(summary)
    own = lengths if lengths is not None else OL.gap_filled(hist).select("length", "freq")
    by_length = [r for r in rows if r["dist3"] < 0]
    low = max(MIN_LENGTH, min((r["dist5"] for r in by_length), default=MIN_LENGTH))
    fit = PF.fit_profile(PF.profile_of(counts, own), o.model, o.eps)
    return Fitted(fit, OP.mismatch_wide(counts), own, low, sum(r["n"] for r in by_length), sum(r["lacking"] for r in by_length))


def fit_tables(spark: SparkSession, table: str, lengths: str, o: Options = Options()) -> Fitted:
    counts, own = tables.read_mismatch_counts(spark, table), tables.read_lengths(spark, lengths, compat=o.compat)
    return Fitted(PF.fit_profile(PF.profile_of(counts, own), o.model, o.eps), OP.mismatch_wide(counts), own)


def fit_bdamage(spark: SparkSession, bdamage: str, rlens: str, o: Options = Options()) -> Fitted:
    """The last taxon with reads, as such files are used for one taxon; fit.fit_by fits each."""
    rows = tables.read_bdamage(spark, bdamage)
    last = rows.agg(F.max("taxid")).head()[0]
    counts = tables.bdamage_counts(rows.where(F.col("taxid") == last)).drop("taxid")
    if o.compat:
        counts = counts.where("NOT (ref = 3 AND read = 3)")
    own = tables.read_rlens(spark, rlens)
    return Fitted(PF.fit_profile(PF.profile_of(counts, own), o.model, o.eps), OP.mismatch_wide(counts), own)


def recalibrate(aligned: DataFrame, fitted: Fitted, o: Options) -> PM.MixtureFit:
    """The length mixture over all reads in the length window; flags are not filtered here."""
    reads = aligned.where(OR.length_filter(o.limit)).select("flag", "length", "ref", "read", "qual")
    return PM.fit_mixture(OS.read_likelihoods(reads, fitted.fit.x, o), o.eps, fitted.len_min, o.limit)


def score(aligned: DataFrame, fitted: Fitted, o: Options, mixture: PM.MixtureFit | None = None) -> DataFrame:
    """Eligible reads, all columns but ref and read, with AN, PD and, with a mixture, AO."""
    rows = OS.read_likelihoods(OR.eligible(aligned, o), fitted.fit.x, o)
    return OS.posterior(rows, o, None if mixture is None else tuple(mixture.x), fitted.len_min).drop("l_err", "l_anc", "l_none")


def run(aligned: DataFrame, o: Options = Options(), other: DataFrame | None = None) -> tuple[Fitted, DataFrame]:
    """Fit to ``aligned`` and score ``other`` (or the same reads), recalibrated by length if o.isrecal is 1."""
    fitted = fit_reads(aligned, o)
    reads = aligned if other is None else other
    return fitted, score(reads, fitted, o, recalibrate(reads, fitted, o) if o.isrecal == 1 else None)


def main(args: list[str] | None = None) -> int:
    """Command line: python -m paleoframe.api -bam reads.sam -ref genome.fa -model nb -oinf out ..."""
    import argparse

    from .sources import alignments, fasta, sinks

    p = argparse.ArgumentParser(prog="paleoframe", allow_abbrev=False)
    for flag in ("bam", "tab", "ref", "len", "ibam", "iref", "obam", "otab", "oinf", "olen", "olik", "bdamage", "rlens", "bed"):
        p.add_argument(f"-{flag}")
    p.add_argument("-model", choices=("b", "nb"), default="nb")
    p.add_argument("-eps", type=float, default=0.0)
    p.add_argument("-isrecal", type=int, default=0)
    p.add_argument("-nthread", "-nthreads", type=int, help="cores of a local master, where no master is set otherwise")
    a = p.parse_args(args)
    if sum(x is not None for x in (a.bam, a.tab, a.bdamage)) != 1:
        p.error("give one of -bam, -tab and -bdamage")
    if (a.tab and not a.len) or (a.bdamage and not a.rlens):
        p.error("-tab needs -len, -bdamage needs -rlens")
    if a.ibam and not a.obam:
        p.error("-ibam needs -obam")
    o = Options(model=a.model, eps=a.eps, isrecal=a.isrecal)
    session = SparkSession.builder.appName("paleoframe")
    if a.nthread and not SparkConf().contains("spark.master"):
        session = session.master(f"local[{a.nthread}]")
    spark = session.getOrCreate()

    def load(path, ref):
        if a.bed:
            bed = tables.read_bed(spark, a.bed)
            reads = OREF.within(alignments.read_alignments(spark, path, OREF.windows(bed)), bed)
        else:
            reads = alignments.read_alignments(spark, path)
        return align(reads, fasta.read(spark, ref) if ref else None, o)

    if a.bam:
        fitted = fit_reads(load(a.bam, a.ref), o, tables.read_lengths(spark, a.len, compat=o.compat) if a.len else None)
    else:
        fitted = fit_tables(spark, a.tab, a.len, o) if a.tab else fit_bdamage(spark, a.bdamage, a.rlens, o)
    rates = OP.profile(fitted.wide).select("idx", "freq_ct", "freq_ga").collect()
    print(sinks.report(rates, fitted.fit))
    if fitted.lacking:
        print(f"reads without qualities: {fitted.lacking} of {fitted.n_reads}")
    if a.otab:
        sinks.write_mismatch_table(fitted.wide, a.otab)
    if a.oinf:
        sinks.write_fit(spark, fitted.fit, a.oinf)
    if a.olen:
        sinks.write_lengths(fitted.lengths, a.olen)
    if a.ibam:
        reads = load(a.ibam, a.iref or a.ref)
        mixture = recalibrate(reads, fitted, o) if o.isrecal == 1 else None
        if mixture is not None:
            print(mixture.row())
        scored = score(reads, fitted, o, mixture)
        if a.obam.endswith(".parquet"):
            sinks.write_reads(scored, a.obam)
        else:
            header = [r["value"] for r in alignments.read_header(spark, a.ibam).collect()]
            (sinks.write_bam if a.obam.endswith(".bam") else sinks.write_sam)(scored, header, a.obam)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
