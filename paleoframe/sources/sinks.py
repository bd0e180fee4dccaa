"""What a run writes. All but scored reads are summaries of some dozen rows, written as one file."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CELLS, POSITIONS, READS
from . import damage


def mismatch_lines(wide: DataFrame) -> DataFrame:
    """line, text: a row for each position of the 5' and then the 3' end, with 16 counts, freqCT and freqGA."""
    number = lambda c: F.format_string("%f", c)
    d = lambda c: F.col(c).cast("double")
    rate = lambda cell: F.try_divide(d(cell), sum((d(cell[0] + x) for x in "CGT"), d(cell[0] + "A")))
    cells = [number(d(c)) for c in CELLS] + [F.coalesce(number(rate(c)), F.lit("nan")) for c in ("CT", "GA")]
    return wide.select(
        F.when(F.col("end") == "5'", F.col("dist")).otherwise(F.col("dist") + POSITIONS).cast("int").alias("line"),
        F.concat_ws("\t", "end", (F.col("dist") + 1).cast("string"), *cells).alias("text"),
    )


def _one_file(lines: DataFrame, path: str, head: list[str], compress: bool) -> None:
    spark = lines.sparkSession
    top = spark.createDataFrame([(i - len(head), t) for i, t in enumerate(head)], "line int, text string")
    out = top.unionByName(lines).orderBy("line").select("text").coalesce(1)
    out.write.mode("overwrite").option("compression", "gzip" if compress else "none").text(path)


def write_mismatch_table(wide: DataFrame, path: str, title: str | None = None) -> None:
    """With a title, a line before the header, the file is not one that read_mismatch_table takes."""
    head = ["\t".join(["Dir.", "Pos.", *CELLS, "freqCT", "freqGA"])]
    _one_file(mismatch_lines(wide), path, ([title] if title else []) + head, True)


def write_lengths(lengths: DataFrame, path: str, binned: Iterable[tuple[float, float]] = ()) -> None:
    """length, freq; then the binned distribution."""
    lines = lengths.select(F.col("length").cast("int").alias("line"), F.format_string("%d\t%f", F.col("length").cast("int"), F.col("freq").cast("double")).alias("text"))
    more = [(1_000_000 + i, f"{a:f}\t{b:f}") for i, (a, b) in enumerate(binned)]
    if more:
        lines = lines.unionByName(lengths.sparkSession.createDataFrame(more, "line int, text string"))
    _one_file(lines, path, [], False)


def fit_line(fit) -> str:
    """Parameters with 95 % intervals, calls and the log-likelihood."""
    names = ("lambda", "delta", "delta_s", "nu")
    parts = [f"{n}: {x:f} ({a:f},{b:f})" for n, x, a, b in zip(names, fit.x, fit.low, fit.high, strict=True)]
    return "\t".join([*parts, f"calls: {fit.calls}", f"llh: {fit.llh:f}"])


def write_fit(spark, fit, path: str) -> None:
    _one_file(spark.createDataFrame([(0, fit_line(fit))], "line int, text string"), path, [], False)


def damage_groups(counts: DataFrame, by: str, n_reads: DataFrame) -> DataFrame:
    """by, n_reads, fw, bw: the counts of each group as 15 x 16 numbers an end, in order of distance and cell."""
    at = F.col("dist") * 16 + F.col("ref") * 4 + F.col("read")
    cell = F.map_from_entries(F.collect_list(F.when(F.col("end") == F.col("_side"), F.struct(at.alias("k"), F.col("n").cast("double").alias("v")))))
    sides = {}
    for name, end in (("fw", "5'"), ("bw", "3'")):
        own = counts.withColumn("_side", F.lit(end)).groupBy(by).agg(cell.alias("m"))
        full = F.transform(F.sequence(F.lit(0), F.lit(16 * POSITIONS - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)))
        sides[name] = own.select(by, full.alias(name))
    return n_reads.join(sides["fw"], by).join(sides["bw"], by)


def write_bdamage(groups: DataFrame, by: str, path: str) -> None:
    """A folder of files in the format of read_bdamage, written by the tasks. groups: of damage_groups, one row a taxon."""
    damage.write(groups, by, path)


def group_lines(groups: DataFrame, by: str) -> DataFrame:
    """A text line a group: its key, its reads and 2 x 15 x 16 numbers."""
    return groups.select(F.concat_ws("\t", F.col(by).cast("string"), F.col("n_reads").cast("string"), *[F.array_join(F.transform(c, lambda v: F.format_string("%f", v)), "\t") for c in ("fw", "bw")]).alias("value"))


def rate_lines(rates: DataFrame) -> DataFrame:
    """line, text: the twelve substitution rates of each position, 5' end first."""
    cells = [(a, b) for a in range(4) for b in range(4) if a != b]
    pick = lambda a, b: F.coalesce(F.sum(F.when((F.col("ref") == a) & (F.col("read") == b), F.col("rate"))), F.lit(0.0))
    wide = rates.groupBy("end", "dist").agg(*[pick(a, b).alias(f"c{a}{b}") for a, b in cells])
    line = F.when(F.col("end") == "5'", F.col("dist")).otherwise(F.col("dist") + POSITIONS).cast("int")
    return wide.select(line.alias("line"), F.concat_ws("\t", *[F.format_string("%f", f"c{a}{b}") for a, b in cells]).alias("text"))


def report(profile_rows, fit, mixture=None) -> str:
    """What a run tells its user: the first five rates of each end, parameters, and the length mixture if there is one."""
    rows = {r["idx"]: r for r in profile_rows}
    number = lambda v: "nan" if v is None else f"{v:f}"
    out = ["5' C>T: " + " ".join(number(rows[i]["freq_ct"]) for i in range(5)), "3' G>A: " + " ".join(number(rows[i]["freq_ga"]) for i in range(5)), fit_line(fit)]
    if mixture is not None:
        out.append("\t".join(f"{k}: {v}" for k, v in mixture.row().items()))
    return "\n".join(out)


def write_reads(scored: DataFrame, path: str) -> None:
    """Scored reads with their float columns, as Parquet."""
    scored.write.mode("overwrite").parquet(path)


TAGS = ("AN", "AO", "PD")


def sam_lines(scored: DataFrame, tags: tuple[str, ...] = TAGS) -> DataFrame:
    """SAM records of scored alignments: nulls as *, the reads' own tags, then the scores as float tags."""
    own = [c for c in tags if c in scored.columns]
    star = lambda c: F.coalesce(c, F.lit("*"))
    kind = F.col("tag_types") if "tag_types" in scored.columns else F.create_map().cast("map<string,string>")
    entries = F.filter(F.map_entries(F.coalesce("tags", F.create_map().cast("map<string,string>"))), lambda e: ~e["key"].isin(*tags))
    kept = F.transform(entries, lambda e: F.concat_ws(":", e["key"], F.coalesce(F.try_element_at(kind, e["key"]), F.lit("Z")), e["value"]))
    scores = F.array_compact(F.array(*[F.concat(F.lit(f"{c}:f:"), F.col(c).cast("string")) for c in own])) if own else F.array().cast("array<string>")
    mate = [F.lit("*"), F.lit("0"), F.lit("0")]
    if "rnext" in scored.columns:
        mate = [F.when(F.col("rnext") == F.col("rname"), "=").otherwise(star(F.col("rnext"))), (F.coalesce("pnext", F.lit(-1)) + 1).cast("string"), F.coalesce("tlen", F.lit(0)).cast("string")]
    qual = F.when((F.size("qual") > 0) & (F.try_element_at("qual", F.lit(1)) != 255), F.array_join(F.transform("qual", lambda q: F.char(q + 33)), ""))
    fields = [
        star(F.col("qname")), F.col("flag").cast("string"), star(F.col("rname")), (F.coalesce("pos", F.lit(-1)) + 1).cast("string"), F.coalesce("mapq", F.lit(255)).cast("string"),
        star(F.col("cigar")), *mate, star(F.col("seq")), star(qual),
    ]
    return scored.select(F.concat_ws("\t", *fields, kept, scores).alias("value"))


def header_of_run(header: list[str], order: str | None = None) -> list[str]:
    """The header's lines with this program's, and with the sort order of what is written."""
    lines = [x for x in header if not x.startswith("@PG\tID:paleoframe\t")]
    if order:
        first = next((x for x in lines if x.startswith("@HD")), "@HD\tVN:1.6")
        kept = [x for x in first.split("\t") if not x.startswith(("SO:", "GO:"))]
        lines = ["\t".join([*kept, f"SO:{order}"])] + [x for x in lines if not x.startswith("@HD")]
    return [*lines, "@PG\tID:paleoframe\tPN:paleoframe\tVN:1.0"]


def write_bam(scored: DataFrame, header: list[str], path: str, tags: tuple[str, ...] = TAGS) -> None:
    """A folder of BAM files in the order of contig and position, each complete and with its index; their ranges do not
    overlap. Scores are float tags.

    Reads are dealt out by ranges of contig, position and a hash, so that a place with very many reads is more than one
    range; those without a place come last.
    """
    from .alignments import header_contigs, register

    spark = scored.sparkSession
    register(spark)
    text = "\n".join(header_of_run(header, "coordinate")) + "\n"
    rows = [(n, k) for k, (n, _) in enumerate(header_contigs(text))]
    places = spark.createDataFrame(rows, "rname string, _tid int")
    columns = [c.split()[0] for c in READS.split(", ")]
    known = scored.select(*columns, *[F.col(c).cast("float").alias(c) for c in tags if c in scored.columns]).join(places, "rname", "left")
    unknown = F.raise_error(F.concat(F.lit("the header has no contig "), F.col("rname"))).cast("int")
    known = known.withColumn("_tid", F.when(F.col("rname").isNull(), 1 << 30).otherwise(F.coalesce("_tid", unknown)))
    order = ["_tid", "pos", F.xxhash64("qname", "flag", "seq")]
    dealt = known.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.select(*columns, *[c for c in tags if c in scored.columns]).write.format("bam").option("header", text).mode("overwrite").save(path)


def write_sam(scored: DataFrame, header: list[str], path: str) -> None:
    """A folder of SAM files, one a task, each beginning with the header, so that each is a file that any tool reads."""
    top = header_of_run(header)

    def run(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array(top)], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])

    sam_lines(scored).mapInArrow(run, "value string").write.mode("overwrite").text(path)
