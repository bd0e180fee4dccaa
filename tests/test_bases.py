import pytest
from pyspark.sql import functions as F

from paleoframe.functions import bases as B
from paleoframe.operators import alignment as A
from paleoframe.operators import reads as R
from paleoframe.operators import reference as REF
from paleoframe.schema import Options


def test_codes(spark):
    df = spark.createDataFrame([(c,) for c in ["A", "c", "G", "t", "N", "0", "3", "-", ""]], "b string")
    assert [r[0] for r in df.select(B.base_code("b")).collect()] == [0, 1, 2, 3, 4, 0, 3, 4, 4]
    df = spark.range(5).select(F.col("id").cast("int").alias("c"))
    assert [r[0] for r in df.select(B.complement("c")).collect()] == [3, 2, 1, 0, 4]
    assert spark.range(1).select(B.complement_letters(F.lit("AACGn"))).head()[0] == "NCGTT"
    q = spark.createDataFrame([(0,), (10,), (255,)], "q int").select(B.phred_error("q")).collect()
    assert [r[0] for r in q] == [1.0, 0.1, None]


def test_md_tokens(spark):
    df = spark.createDataFrame([("10A5^AC6",), ("12",), ("0C",), ("3^G0T2",)], "md string")
    got = [[tuple(x) for x in r[0]] for r in df.select(B.md_tokens("md")).collect()]
    assert got == [[("A", 10), ("#", 5), ("^", 2)], [], [("C", 0)], [("#", 3), ("^", 1), ("T", 0)]]


def test_cigar(spark):
    assert spark.range(1).select(B.cigar_expand(F.lit("2S3M1I1D"))).head()[0] == "SSMMMID"


def test_flags_and_lengths(spark):
    rows = [(f, n) for f in (0, 1, 4, 16, 256, 272, 512, 1024) for n in (29, 30, 149, 150)]
    df = spark.createDataFrame(rows, "flag int, length int").withColumn("mapq", F.lit(0))
    assert {tuple(r) for r in R.eligible(df).select("flag", "length").collect()} == {(f, n) for f in (0, 4, 16, 256) for n in (30, 149)}
    assert R.eligible(df, Options(mapped_only=True)).where("flag = 4").count() == 0


def test_unmapped_reads_are_an_error(spark):
    df = spark.createDataFrame([(1, 4)], "read_id long, flag int")
    with pytest.raises(Exception, match="unmapped read: 1"):
        R.reject_unmapped(df).collect()


def test_references_under_a_read():
    # two clipped, three matches with one mismatch, an insertion, a deletion
    assert A.reference_of_md("2S3M1I2M1D2M", "1T3^G2", "GGACAAACCC") == [4, 4, 0, 3, 0, 4, 0, 1, 1, 1]
    assert A.reference_of_md("2S3M1I2M1D2M", "1T3^G2", "GGACAAACCC", compat=True) == [4] * 10
    assert A.reference_of_bases("2S3M1I2M1D2M", "ATAACGCC", "GGACAAACCC") == [4, 4, 0, 3, 0, 4, 0, 1, 1, 1]
    for bad in ("5M2Q", "3=", "4M", "5", "M", ""):
        with pytest.raises(ValueError):
            A.reference_of_md(bad, "5", "ACGTA")


def test_end_bases_of_reverse_and_short_reads(spark):
    rows = [(1, 0, 3, [0, 1, 2], [0, 3, 4], [30, 31, 32]), (2, 16, 3, [0, 1, 2], [0, 1, 2], [30, 31, 32]), (3, 0, 0, [], [], [])]
    df = spark.createDataFrame(rows, "read_id long, flag int, length int, ref array<int>, read array<int>, qual array<int>")
    got = {tuple(r) for r in R.end_bases(df).collect()}
    assert got == {(1, 0, 2, 0, 0, 30), (1, 1, 1, 1, 3, 31), (2, 2, 0, 3, 3, 30), (2, 1, 1, 2, 2, 31), (2, 0, 2, 1, 1, 32)}


def test_fetch_over_chunk_borders(spark):
    chunks = spark.createDataFrame([("c", 0, "ACGT"), ("c", 1, "TTGA"), ("c", 2, "CC")], "rname string, chunk_id long, seq string")
    want = spark.createDataFrame([(1, "c", 2, 9), (2, "c", 0, 0), (3, "x", 0, 3)], "key long, rname string, begin long, end long")
    assert {(r.key, r.bases) for r in REF.fetch(want, chunks, 4).collect()} == {(1, "GTTTGACC"), (2, "A")}


def test_intervals(spark):
    bed = spark.createDataFrame([("c", 5, 10), ("c", 6, 40000)], "chrom string, start long, end long")
    reads = spark.createDataFrame([(p, "c", p) for p in (4, 5, 9, 39999, 40000)] + [(99, "d", 7)], "id long, rname string, pos long")
    assert sorted(r.id for r in REF.within(reads, bed).collect()) == [5, 9, 39999]


def plain_reference(source, cigar, other, seq):
    """One base after the other."""
    import re

    code = lambda c: "ACGT".find(c.upper()) if c.upper() in "ACGT" else 4
    if source == "md":
        under = []
        for number, gone, base in re.findall(r"(\d+)|(\^[A-Za-z]+)|([A-Za-z])", other):
            under += [None] * int(number) if number else [] if gone else [code(base)]
    out, at, place = [], 0, 0
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
        for _ in range(int(n)):
            if op in "M=X":
                if source == "md":
                    out.append(code(seq[at]) if under[place] is None else under[place])
                else:
                    out.append(code(other[place]) if place < len(other) else 4)
            elif op in "IS":
                out.append(4)
            at += op in "MIS=X"
            place += op in "M=X" or (op in "DN" and source != "md")
    return out


def plain_places(cigar):
    import re

    out, place = [], 0
    for n, op in re.findall(r"(\d+)(.)", cigar):
        for _ in range(int(n)):
            if op in "MIS=X":
                out.append(place if op in "M=X" else -1)
            place += op in "MDN=X"
    return out


def test_references_of_many_reads_at_once():
    import random

    rng = random.Random(4)
    rows = {"md": [], "bases": []}
    for _ in range(300):
        ops, md, run, seq, ref = [], "", 0, "", ""
        for k in range(rng.randint(1, 6)):
            op, n = rng.choice("MMMIDS=XNHP" if k else "MMSH="), rng.choice([1, 2, 5, 12])
            if ops and ops[-1][1] == op:
                continue
            ops.append((n, op))
            bases = "".join(rng.choice("ACGTNacgt") for _ in range(n))
            if op in "MIS=X":
                seq += bases
            if op in "M=X":
                for c in bases:
                    if rng.random() < 0.3:
                        md, run = f"{md}{run}{(x := rng.choice('ACGTN'))}", 0
                        ref += x
                    else:
                        run, ref = run + 1, ref + c
            elif op == "D":
                md, run = f"{md}{run}^{bases.upper().replace('N', 'A')}", 0
                ref += bases
            elif op == "N":
                ref += bases
        cigar = "".join(f"{n}{o}" for n, o in ops)
        if seq:
            rows["md"].append((cigar, f"{md}{run}", seq))
            rows["bases"].append((cigar, ref[: rng.choice([len(ref), len(ref) - 1])], seq))
    for source, own in rows.items():
        ref, read, sizes = A.reference_under(source, *map(list, zip(*own, strict=True)))
        assert ref.tolist() == [x for r in own for x in plain_reference(source, *r)] and sizes.tolist() == [len(r[2]) for r in own]
        assert A.places_under([r[0] for r in own], sizes).tolist() == [x for r in own for x in plain_places(r[0])]
