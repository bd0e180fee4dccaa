"""Column functions on bases, qualities, CIGAR and MD strings.

Base codes: A 0, C 1, G 2, T 3, anything else 4; code 4 is never counted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Alignments store bases as four bits each; fixed order of that code.
NIBBLES = "=ACMGRSVTWYHKDBN"
CIGAR_OPS = "MIDNSHP=X"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def base_code(base: Column | str) -> Column:
    """Letters in either case and the digits 0 to 3."""
    b = F.upper(_col(base))
    at = F.instr(F.lit("ACGT0123"), b)
    return F.when((F.length(b) == 1) & (at > 0), (at - 1) % 4).otherwise(4)


def base_letter(code: Column | str) -> Column:
    return F.substring(F.lit("ACGTN"), _col(code).cast("int") + 1, F.lit(1))


def complement(code: Column | str) -> Column:
    c = _col(code)
    return F.when(c < 4, 3 - c).otherwise(4)


def complement_letters(seq: Column | str) -> Column:
    """Reverse complement of a sequence; other letters become N."""
    return F.translate(F.reverse(F.regexp_replace(F.upper(_col(seq)), "[^ACGT]", "N")), "ACGT", "TGCA")


def is_reverse(flag: Column | str) -> Column:
    return _col(flag).bitwiseAND(F.lit(16)) != 0


def distances(cycle: Column | str, length: Column | str, flag: Column | str) -> tuple[Column, Column]:
    """0-based distances of a cycle from the molecule's 5' and 3' end."""
    c, rest = _col(cycle), _col(length) - 1 - _col(cycle)
    rev = is_reverse(flag)
    return F.when(rev, rest).otherwise(c), F.when(rev, c).otherwise(rest)


def substitution(ref: Column | str, read: Column | str) -> Column:
    return _col(ref) * 4 + _col(read)


def phred_error(q: Column | str) -> Column:
    """Error probability; the value 255 stands for a missing quality and gives null."""
    c = _col(q)
    return F.when(c != 255, F.pow(F.lit(10.0), -c / F.lit(10.0)))


def cigar_ops(cigar: Column | str) -> Column:
    """array<struct<op, len>> of a CIGAR string."""
    c = _col(cigar)
    lens = F.regexp_extract_all(c, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1))
    ops = F.regexp_extract_all(c, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2))
    return F.zip_with(ops, lens, lambda o, n: F.struct(o.alias("op"), n.cast("int").alias("len")))


def cigar_expand(cigar: Column | str) -> Column:
    """One operation letter a base."""
    return F.array_join(F.transform(cigar_ops(cigar), lambda x: F.repeat(x["op"], x["len"])), "")


def md_tokens(md: Column | str) -> Column:
    """array<struct<bp, off>> of an MD tag: a mismatched base with the matches before it, or '^' with the length of a
    deletion, after '#' with the matches before that if there are any. A trailing number gives no token."""
    parts = F.regexp_extract_all(_col(md), F.lit(r"(\d+|\^[A-Za-z]+|[A-Za-z])"), F.lit(1))
    token = lambda bp, off: F.struct(bp.alias("bp"), off.cast("int").alias("off"))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<bp:string,off:int>>").alias("out"))

    def step(acc, x):
        number = x.rlike(r"^\d")
        deletion = x.startswith("^")
        before = F.when(acc["n"] > 0, F.array(token(F.lit("#"), acc["n"]))).otherwise(F.array().cast("array<struct<bp:string,off:int>>"))
        gone = F.concat(acc["out"], before, F.array(token(F.lit("^"), F.length(x) - 1)))
        base = F.concat(acc["out"], F.array(token(F.upper(x), acc["n"])))
        return F.struct(
            F.when(number, acc["n"] + F.try_to_number(x, F.lit("999999999")).cast("int")).otherwise(0).alias("n"),
            F.when(number, acc["out"]).when(deletion, gone).otherwise(base).alias("out"),
        )

    return F.aggregate(parts, start, step, lambda acc: acc["out"])
