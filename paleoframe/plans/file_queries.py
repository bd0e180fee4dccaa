"""Queries that write files from the driver's tables in the formats of a run and read them again, so that writers and readers
have the same result in SQL as everything else."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..functions import bases as FB
from ..operators import lengths as OL
from ..operators import profile as OP
from ..operators import reads as OR
from ..operators import reference as OREF
from ..schema import POSITIONS, Options
from ..sources import alignments as SA
from ..sources import derived as D
from ..sources import scratch, sinks, tables
from .queries import _BED, _CTE, _HIST, _WIDE, SQL, aligned, all_reads, counts, query, reads, rounded, wide

HEADER = ["@HD\tVN:1.6", *(f"@SQ\tSN:c{t}\tLN:{100000 + t}" for t in range(4))]
#: The mate's contig and place; c as in derived.READ.
RNEXT = "CASE CAST(read_id % 3 AS INT) WHEN 0 THEN concat('c', tid) WHEN 1 THEN 'c0' END"
PNEXT = "CASE WHEN read_id % 3 = 2 THEN -1 ELSE pos * 3 % 100000 END"
TLEN = "CAST(read_id % 300 - 150 AS INT)"
#: A whole read has qualities or none, as text formats cannot say more.
QUAL = "CASE WHEN e % 23 = 0 THEN 255 ELSE 20 + (e + c * 3) % 21 END"


def md_string(ref: str, read: str):
    """The MD tag of codes that lie side by side, one for one."""
    pairs = F.zip_with(ref, read, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("run"))
    step = lambda s, x: F.when(x["a"] == x["b"], F.struct(s["text"].alias("text"), (s["run"] + 1).alias("run"))).otherwise(
        F.struct(F.concat(s["text"], s["run"].cast("string"), FB.base_letter(x["a"])).alias("text"), F.lit(0).alias("run"))
    )
    return F.aggregate(pairs, start, step, lambda s: F.concat(s["text"], s["run"].cast("string")))


def records(spark: SparkSession, d: str) -> DataFrame:
    """READS rows of the eligible reads, each aligned base for base, with MD and NM and a mate."""
    rows = aligned(spark, d)
    cycles = F.sequence(F.lit(0), F.col("length") - 1)
    rev = F.col("flag").bitwiseAND(F.lit(16)) != 0
    c = F.when(rev, F.reverse(cycles)).otherwise(cycles)
    differ = F.size(F.filter(F.zip_with("ref", "read", lambda a, b: a != b), lambda x: x))
    return rows.select(
        F.concat(F.lit("r"), F.col("read_id")).alias("qname"), "flag", F.concat(F.lit("c"), F.col("tid")).alias("rname"), "pos", "mapq",
        F.concat(F.col("length"), F.lit("M")).alias("cigar"), F.array_join(F.transform("read", FB.base_letter), "").alias("seq"),
        F.transform(c, lambda k: F.when(F.col("read_id") % 23 == 0, 255).otherwise(20 + (F.col("read_id") + k.cast("long") * 3) % 21).cast("int")).alias("qual"),
        F.create_map(F.lit("MD"), md_string("ref", "read"), F.lit("NM"), differ.cast("string")).alias("tags"), F.create_map(F.lit("MD"), F.lit("Z"), F.lit("NM"), F.lit("i")).alias("tag_types"),
        F.expr(RNEXT).alias("rnext"), F.expr(PNEXT).cast("long").alias("pnext"), F.expr(TLEN).alias("tlen"),
    )


def written(spark: SparkSession, d: str, kind: str) -> str:
    """Where the records are, as a folder of BAM or of SAM files."""
    path = scratch.fresh(spark, f"reads.{kind}")
    (sinks.write_bam if kind == "bam" else sinks.write_sam)(records(spark, d), HEADER, path)
    return path


def shown(read: DataFrame) -> DataFrame:
    quality = F.array_join(F.transform("qual", lambda q: F.when(q == 255, "*").otherwise(F.char(q + 33))), "")
    return read.select("qname", "flag", "rname", "pos", "mapq", "cigar", "seq", quality.alias("quality"), F.col("tags")["MD"].alias("md"), F.col("tags")["NM"].cast("int").alias("nm"), "rnext", "pnext", "tlen")


_RECORDS = _CTE + f""", cycles AS (SELECT *, CASE WHEN flag & 16 <> 0 THEN n - 1 - i ELSE i END AS c FROM
  (SELECT read_id, flag, read_id AS e, CAST(length AS BIGINT) AS n, unnest(range(length)) AS i FROM eligible))
, codes AS (SELECT read_id, i, flag & 16 <> 0 AS rev, r, {D.READ_BASE} AS m, {QUAL} AS q FROM (SELECT *, {D.REF} AS r, {D.HASH} AS h FROM cycles))
, stored AS (SELECT read_id, i, CASE WHEN rev THEN 3 - r ELSE r END AS a, CASE WHEN m > 3 THEN 4 WHEN rev THEN 3 - m ELSE m END AS b, q FROM codes)
, line AS (SELECT read_id, string_agg(substr('ACGTN', CAST(b + 1 AS INT), 1), '' ORDER BY i) AS seq, string_agg(CASE WHEN q = 255 THEN '*' ELSE chr(CAST(q + 33 AS INT)) END, '' ORDER BY i) AS quality
  FROM stored GROUP BY read_id)
, miss AS (SELECT read_id, i, a, i - 1 - coalesce(lag(i) OVER (PARTITION BY read_id ORDER BY i), -1) AS run FROM stored WHERE a <> b)
, named AS (SELECT read_id, string_agg(concat(run, substr('ACGT', CAST(a + 1 AS INT), 1)), '' ORDER BY i) AS head, max(i) AS last, count(*) AS nm FROM miss GROUP BY read_id)
SELECT concat('r', read_id) AS qname, flag, concat('c', tid) AS rname, pos, mapq, concat(length, 'M') AS cigar, seq, quality,
  concat(coalesce(head, ''), length - 1 - coalesce(last, -1)) AS md, CAST(coalesce(nm, 0) AS INT) AS nm, {RNEXT} AS rnext, {PNEXT} AS pnext, {TLEN} AS tlen
FROM eligible JOIN line USING (read_id) LEFT JOIN named USING (read_id)"""


@query(_RECORDS)
def bam_records(spark, d):
    return shown(SA.read_alignments(spark, written(spark, d, "bam")))


@query(_RECORDS)
def sam_records(spark, d):
    return shown(SA.read_alignments(spark, written(spark, d, "sam")))


@query(_RECORDS.replace("FROM eligible JOIN", "FROM (SELECT * FROM eligible WHERE tid = 1 AND pos >= 30000 AND pos < 60000 AND mapq > 10) JOIN"))
def bam_pushed_filters(spark, d):
    """Filters that reach the reader and choose its bytes by the files' indexes."""
    return shown(SA.read_alignments(spark, written(spark, d, "bam")).where("rname = 'c1' AND pos >= 30000 AND pos < 60000 AND mapq > 10"))


@query(SQL["bed_semi_join"])
def bam_regions(spark, d):
    bed = spark.createDataFrame(_BED, "chrom string, start long, end long")
    found = OREF.within(SA.read_alignments(spark, written(spark, d, "bam"), OREF.windows(bed)), bed)
    return found.select(F.substring("qname", 2, 20).cast("long").alias("read_id"), "rname", "pos")


@query("SELECT concat('c', tid) AS rname, CAST(100000 + tid AS BIGINT) AS length, count(*) AS n_reads FROM (" + _CTE + "SELECT tid FROM eligible) GROUP BY tid")
def bam_contigs(spark, d):
    path = written(spark, d, "bam")
    n = SA.read_alignments(spark, path).groupBy("rname").agg(F.count(F.lit(1)).alias("n_reads"))
    return SA.contigs(SA.read_header(spark, path)).join(n, "rname")


@query(_CTE + _WIDE + "SELECT * FROM wide")
def bam_to_counts(spark, d):
    """From a BAM file to counts as a fit makes them: references from MD, one pass."""
    summary = OP.read_summary(api.align(SA.read_alignments(spark, written(spark, d, "bam"))))
    return OP.mismatch_wide(OP.summary_counts(summary))


@query(_CTE + _HIST + "SELECT length, n FROM hist")
def bam_to_lengths(spark, d):
    return OP.summary_lengths(OP.read_summary(api.align(SA.read_alignments(spark, written(spark, d, "sam")))))


# filters

_UNMAPPED = "flag + CASE WHEN read_id % 7 = 0 THEN 4 ELSE 0 END + CASE WHEN read_id % 19 = 0 THEN 512 ELSE 0 END"


def _flagged(spark, d):
    return all_reads(spark, d).withColumn("flag", F.expr(_UNMAPPED).cast("int"))


@query(_CTE + f", f AS (SELECT read_id, length, {_UNMAPPED} AS flag FROM reads) SELECT read_id, CAST(flag AS INT) AS flag, length FROM f WHERE flag & 5 = 0 AND flag <= 256 AND length >= 30 AND length < 100")
def read_mapped_only(spark, d):
    return OR.eligible(_flagged(spark, d), Options(mapped_only=True, len_limit=100)).select("read_id", "flag", "length")


@query(_CTE + f", f AS (SELECT read_id, length, {_UNMAPPED} AS flag FROM reads) SELECT read_id, CAST(flag AS INT) AS flag, length FROM f WHERE flag & 3589 = 0 AND length >= 35")
def read_profile_tool(spark, d):
    return _flagged(spark, d).where(OR.profile_tool_filter()).select("read_id", "flag", "length")


@query(_CTE + 'SELECT "end", dist, ref, read, count(*) AS n FROM near WHERE qual >= 30 GROUP BY ALL')
def mismatch_min_quality(spark, d):
    rows = OR.orient(D.stored_bases(reads(spark, d)), ("read_id",), 30)
    return OP.mismatch_counts(rows)


# summary files


@query(_CTE + 'SELECT "end", dist, ref, read, n FROM mm')
def mismatch_table_file(spark, d):
    path = scratch.fresh(spark, "mismatch")
    sinks.write_mismatch_table(wide(spark, d), path)
    return tables.read_mismatch_counts(spark, path).where("n > 0").withColumn("n", F.col("n").cast("long"))


_FREQ = _CTE + _HIST + ", shown AS (SELECT length, round(n / (SELECT CAST(sum(n) AS DOUBLE) FROM hist), 6) AS f FROM hist) "


@query(_FREQ + "SELECT length, round(f / (SELECT sum(f) FROM shown), 9) AS freq FROM shown")
def lengths_file(spark, d):
    path = scratch.fresh(spark, "lengths")
    sinks.write_lengths(OL.gap_filled(OL.length_histogram(reads(spark, d))), path)
    return rounded(tables.read_lengths(spark, path).where("freq > 0"), 9, "freq")


_BINS = 17
_EDGES = "(SELECT min(length) - 0.5::DOUBLE AS low, (max(length) - min(length) + 1) / 17.0::DOUBLE AS width, CAST(sum(n) AS DOUBLE) AS total FROM hist)"


@query(
    _CTE + _HIST + f"""SELECT CAST(k AS INT) AS bin, round(low + (k + 0.5::DOUBLE) * width, 9) AS centre, round(sum(n / total * greatest(0, least(length + 0.5::DOUBLE, low + (k + 1) * width) - greatest(length - 0.5::DOUBLE, low + k * width))), 9) AS freq
FROM hist, {_EDGES}, range({_BINS}) t(k) GROUP BY k, low, width"""
)
def lengths_rebinned(spark, d):
    rows = sorted((r["length"], r["freq"]) for r in OL.gap_filled(OL.length_histogram(reads(spark, d))).collect())
    centres, freqs = OL.rebin([a for a, _ in rows], [b for _, b in rows], _BINS)
    out = [(k, float(c), float(f)) for k, (c, f) in enumerate(zip(centres, freqs, strict=True))]
    return rounded(spark.createDataFrame(out, "bin int, centre double, freq double"), 9, "centre", "freq")


def _groups(spark, d):
    n = reads(spark, d).groupBy("taxid").agg(F.count(F.lit(1)).alias("n_reads"))
    return sinks.damage_groups(counts(spark, d, "taxid"), "taxid", n)


_BY_TAXON = _CTE + ', t AS (SELECT taxid, "end", dist, ref, read, count(*) AS n FROM near GROUP BY ALL), k AS (SELECT taxid, count(*) AS n_reads FROM eligible GROUP BY taxid) '


@query(_BY_TAXON + 'SELECT CAST(taxid AS INT) AS taxid, CAST(n_reads AS INT) AS n_reads, "end", dist, ref, read, n FROM t JOIN k USING (taxid)')
def damage_file(spark, d):
    rows = _damage_rows(spark, d)
    own = rows.select("taxid", F.col("nreads").alias("n_reads"))
    return tables.bdamage_counts(rows).where("n > 0").withColumn("n", F.col("n").cast("long")).join(own, "taxid")


_ALL_CELLS = f"(SELECT CAST(k // 16 AS INT) AS dist, CAST(k % 16 // 4 AS INT) AS ref, CAST(k % 4 AS INT) AS read, k FROM range({16 * POSITIONS}) t(k))"


@query(
    _BY_TAXON + f"""SELECT concat_ws(chr(9), taxid, n_reads, string_agg(printf('%f', CAST(coalesce(n, 0) AS DOUBLE)), chr(9) ORDER BY side DESC, k)) AS value
FROM (SELECT k.taxid, n_reads, side, c.k, n FROM k, (VALUES ('5'''), ('3''')) e(side), {_ALL_CELLS} c LEFT JOIN t ON t.taxid = k.taxid AND t."end" = side AND t.dist = c.dist AND t.ref = c.ref AND t.read = c.read)
GROUP BY taxid, n_reads"""
)
def damage_text(spark, d):
    return sinks.group_lines(_groups(spark, d), "taxid")


_SHARES = ", chr(9), ".join(f"printf('%f', coalesce(sum(CASE WHEN ref = {k // 4} AND read = {k % 4} THEN rate END), 0))" for k in range(16) if k // 4 != k % 4)


@query(
    _CTE + f""", s AS (SELECT "end", dist, ref, read, n / CAST(sum(n) OVER (PARTITION BY "end", dist, ref) AS DOUBLE) AS rate FROM mm)
SELECT CAST(CASE WHEN "end" = '5''' THEN dist ELSE dist + {POSITIONS} END AS INT) AS line, concat({_SHARES}) AS text FROM s GROUP BY "end", dist"""
)
def rate_lines(spark, d):
    return sinks.rate_lines(OP.substitution_rates(counts(spark, d)))


def _damage_rows(spark, d):
    path = scratch.fresh(spark, "taxa")
    sinks.write_bdamage(_groups(spark, d), "taxid", path)
    return tables.read_bdamage(spark, path)


@query("SELECT * REPLACE (CAST(taxid AS INT) AS taxid, CAST(n_reads AS INT) AS n_reads) FROM (" + SQL["bdamage_summary"] + ")")
def damage_file_summary(spark, d):
    return rounded(tables.bdamage_summary(_damage_rows(spark, d), 5), 6, "ct", "ga", "other")


def _text(df: DataFrame, name: str) -> str:
    path = scratch.fresh(df.sparkSession, name)
    df.write.text(path)
    return path


_STATS = _CTE + """SELECT CAST(taxid AS VARCHAR) AS taxid, count(*) AS nreads, round(avg(length), 6) AS mean_len, round(avg(CAST(length AS DOUBLE) * length) - avg(length) * avg(length), 4) AS var_len,
  round(avg(mapq), 6) AS mean_gc, CAST(NULL AS DOUBLE) AS var_gc FROM eligible GROUP BY taxid"""


@query(_STATS)
def taxon_stats_file(spark, d):
    """Statistics of taxa as text and back; mapping qualities stand for shares of GC, which reads alone don't have."""
    n = F.col("length").cast("double")
    own = reads(spark, d).groupBy("taxid").agg(F.count(F.lit(1)).alias("n"), F.avg(n).alias("a"), (F.avg(n * n) - F.avg(n) * F.avg(n)).alias("v"), F.avg("mapq").alias("q"))
    path = _text(own.select(F.concat_ws(" ", "taxid", "n", F.col("a").cast("string"), F.col("v").cast("string"), F.col("q").cast("string"), F.lit("NA")).alias("value")), "stats")
    return rounded(rounded(tables.read_taxon_stats(spark, path), 6, "mean_len", "mean_gc"), 4, "var_len")


@query(SQL["length_dist_rlens_style"])
def rlens_file(spark, d):
    """The lengths as a table of two lines, of which some dozen to some hundred columns are the histogram."""
    by = OL.length_histogram(all_reads(spark, d)).agg(F.sort_array(F.collect_list(F.struct("length", "n"))).alias("h"))
    cells = lambda k: F.array_join(F.transform("h", k), "\t")
    head = F.concat(F.lit("id\t"), cells(lambda x: F.concat(F.lit("rlen"), x["length"])))
    lines = by.select(F.explode(F.array(head, F.concat(F.lit("all\t"), cells(lambda x: x["n"].cast("string"))))).alias("value"))
    return rounded(tables.read_rlens(spark, _text(lines.coalesce(1), "rlens")), 9, "freq")
