"""Read filters and the rows of end bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bases import complement, distances, is_reverse
from ..schema import LENGTH_LIMIT, MIN_LENGTH, POSITIONS, Options


def flag_filter(o: Options, flag: str = "flag") -> Column:
    """Single-end reads whose flag, as a number, is at most 256."""
    f = F.col(flag)
    keep = f <= 256
    if o.single_end:
        keep &= f.bitwiseAND(F.lit(1)) == 0
    if o.mapped_only:
        keep &= f.bitwiseAND(F.lit(4)) == 0
    return keep


def length_filter(limit: int = LENGTH_LIMIT, length: str = "length") -> Column:
    """MIN_LENGTH up to, not including, the limit."""
    return (F.col(length) >= MIN_LENGTH) & (F.col(length) < limit)


def eligible(reads: DataFrame, o: Options = Options()) -> DataFrame:
    keep = flag_filter(o) & length_filter(o.limit)
    if o.min_mapq is not None:
        keep &= F.col("mapq") >= o.min_mapq
    return reads.where(keep)


def reject_unmapped(reads: DataFrame) -> DataFrame:
    """An unmapped read here is an error, raised when its row is computed."""
    unmapped = F.col("flag").bitwiseAND(F.lit(4)) != 0
    message = F.concat(F.lit("unmapped read: "), F.col("read_id").cast("string"))
    return reads.withColumn("flag", F.when(unmapped, F.raise_error(message).cast("int")).otherwise(F.col("flag")))


def failed(flag: str = "flag") -> Column:
    """Quality failure, duplicate or supplementary alignment, by their bits."""
    return F.col(flag).bitwiseAND(F.lit(512 | 1024 | 2048)) != 0


def profile_tool_filter(flag: str = "flag", length: str = "length") -> Column:
    """What per-taxon profiles count: mapped single-end reads that have not failed, of 35 bases or more."""
    f = F.col(flag)
    return ~failed(flag) & (f.bitwiseAND(F.lit(4)) == 0) & (f.bitwiseAND(F.lit(1)) == 0) & (F.col(length) >= 35)


def end_bases(aligned: DataFrame, keep: tuple[str, ...] = ("read_id",), positions: int = POSITIONS, min_quality: int | None = None) -> DataFrame:
    """One row for each base near an end: dist5, dist3, ref, read, qual; bases without a code are left out.

    Only end positions are exploded, at most twice ``positions`` rows a read.
    """
    rows = aligned.where("length > 0").select(*keep, "flag", "length", "ref", "read", "qual", end_cycles(positions).alias("cycle"))
    at = F.col("cycle") + 1
    rows = rows.withColumns({c: F.element_at(c, at) for c in ("ref", "read", "qual")})
    return orient(rows, keep, min_quality)


def end_cycles(positions: int = POSITIONS) -> Column:
    """Explodes the places of a read that are near an end."""
    return F.explode(end_places(positions))


def end_places(positions: int = POSITIONS) -> Column:
    n = F.col("length")
    head = F.sequence(F.lit(0), F.least(F.lit(positions), n) - 1)
    tail = F.when(n > positions, F.sequence(F.greatest(F.lit(positions), n - positions), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.concat(head, tail)


def orient(rows: DataFrame, keep: tuple[str, ...] = ("read_id",), min_quality: int | None = None) -> DataFrame:
    """From one row a base (flag, length, cycle, ref, read, qual in the order of the reference) to dist5, dist3 and codes
    as they are on the molecule.

    Bases without a code go first: a complement never changes which those are, and a filter above it would be pushed
    down with the complement written out in it.
    """
    kept = rows.where("ref < 4 AND read < 4")
    if min_quality:
        kept = kept.where(F.col("qual") >= min_quality)
    d5, d3 = distances("cycle", "length", "flag")
    rev = is_reverse("flag")
    one = lambda c: F.when(rev, 3 - F.col(c)).otherwise(F.col(c))
    return kept.select(*keep, d5.cast("int").alias("dist5"), d3.cast("int").alias("dist3"), one("ref").alias("ref"), one("read").alias("read"), "qual")


def ends(aligned: DataFrame, positions: int = POSITIONS) -> DataFrame:
    """ref5, read5, qual5 and ref3, read3, qual3: the first and last bases, each counted from its own end.

    Only these are turned and complemented, not whole reads. Alignments (rows with a column seq) keep their qualities.
    """
    rev = is_reverse("flag")
    cut = {}
    for c in ("ref", "read", "qual"):
        turn = (lambda x: F.transform(x, complement)) if c != "qual" else (lambda x: x)
        head, tail = F.slice(c, 1, positions), F.slice(F.reverse(c), 1, positions)
        cut[f"{c}5"] = F.when(rev, turn(tail)).otherwise(head)
        cut[f"{c}3"] = F.when(rev, turn(head)).otherwise(tail)
    return aligned.withColumns(cut).drop("ref", "read", *([] if "seq" in aligned.columns else ["qual"]))
