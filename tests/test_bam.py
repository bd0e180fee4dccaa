"""BAM files: written and read back, split without an index, read by regions, and nothing left of failed tasks."""

import os
import random

import numpy as np
import pytest

from paleoframe import api
from paleoframe.operators import reference
from paleoframe.schema import READS
from paleoframe.sources import alignments, bam, sinks

COLUMNS = [c.split()[0] for c in READS.split(", ")]
CONTIGS = [("c1", 1_000_000), ("c2", 200_000_000), ("other", 500)]
HEADER = ["@HD\tVN:1.6\tSO:unsorted\tGO:query", *(f"@SQ\tSN:{n}\tLN:{k}" for n, k in CONTIGS), "@CO\ta line: of words"]


def reads(n=600, seed=4):
    r, out = random.Random(seed), []
    for k in range(n):
        size = r.choice([0, 1, 7, 30, 33, 80, 149])
        tid = r.choice([0, 0, 1, 1, 1, 2, None])
        rname = None if tid is None else CONTIGS[tid][0]
        pos = -1 if tid is None else r.choice([0, 16_383, 16_384, 131_071, 131_072, 400_000]) % CONTIGS[tid][1] if k % 3 else r.randrange(CONTIGS[tid][1])
        cigar = None if tid is None or not size else f"{size}M" if size < 8 else f"2S{size - 5}M1D3I" if k % 2 else f"1H{size - 4}=1X70000N3M2P"
        seq = "".join(r.choice("ACGTN=RY") for _ in range(size)) or None
        qual = [255] * size if k % 7 == 0 else [r.randrange(0, 94) for _ in range(size)]
        tags = {"MD": str(size), "NM": str(r.choice([0, 200, -5, 70_000, 4_000_000_000, -70_000])), "XA": "q", "XF": "0.10000000149011612", "XH": "1AE301", "XB": "c,1,-2", "XS": "S,65535", "XG": "f,1.5,-0.25", "XI": "I,4294967295"}
        types = {"MD": "Z", "NM": "i", "XA": "A", "XF": "f", "XH": "H", "XB": "B", "XS": "B", "XG": "B", "XI": "B"}
        kept = [] if k % 11 == 0 else r.sample(sorted(tags), r.randrange(1, 10))
        mate = r.choice([(None, -1, 0), (rname, 446, 447), ("c2", 5, -3)])
        flag = 4 if tid is None else r.choice([0, 16, 99, 1024])
        out.append((f"r{k}", flag, rname, pos, r.randrange(0, 256), cigar, seq, qual, {t: tags[t] for t in kept}, {t: types[t] for t in kept}, *mate))
    return out


def table(spark, rows, parts=4):
    return spark.createDataFrame(rows, READS).repartition(parts)


def same(a, b):
    return sorted(map(str, a)) == sorted(map(str, b))


def plain(row):
    return tuple(sorted(v.items()) if isinstance(v, dict) else v for v in row)


def test_written_and_read_back(spark, tmp_path):
    rows = reads()
    df = table(spark, rows).selectExpr("*", "CAST(IF(mapq % 5 = 0, NULL, mapq / 300) AS FLOAT) AS AN", "CAST(0.125 AS DOUBLE) AS PD")
    out = str(tmp_path / "x.bam")
    sinks.write_bam(df, HEADER, out)
    files = sorted(os.listdir(out))
    assert not [f for f in files if f.startswith(".parts")] and "_SUCCESS" in files
    assert [f + ".bai" in files for f in files if f.endswith(".bam")] == [True] * sum(f.endswith(".bam") for f in files) != []
    back = alignments.read_alignments(spark, out).collect()
    want = []
    for r in rows:
        scores = {"PD": "0.125"} if r[4] % 5 == 0 else {"AN": str(float(np.float32(r[4] / 300))), "PD": "0.125"}
        want.append(plain((*r[:8], r[8] | scores, r[9] | dict.fromkeys(scores, "f"), *r[10:])))
    assert same([plain(r) for r in back], want)
    # parts in order, and each in order
    order = {n: k for k, (n, _) in enumerate(CONTIGS)} | {None: 9}
    keys = []
    for f in files:
        if f.endswith(".bam"):
            own = [(order[r.rname], r.pos) for r in alignments.read_alignments(spark, f"{out}/{f}").collect()]
            assert own == sorted(own)
            keys += own
    assert keys == sorted(keys) and len(keys) == len(rows)
    lines = [r.value for r in alignments.read_header(spark, out).collect()]
    assert lines[0] == "@HD\tVN:1.6\tSO:coordinate" and [x for x in lines if x.startswith("@SQ")] == HEADER[1:4] and lines[-1].startswith("@PG\tID:paleoframe")
    # written again over itself, and without rows
    sinks.write_bam(table(spark, rows[:5]), HEADER, out)
    assert alignments.read_alignments(spark, out).count() == 5
    sinks.write_bam(table(spark, []), HEADER, str(tmp_path / "none.bam"))
    assert alignments.read_alignments(spark, str(tmp_path / "none.bam")).count() == 0
    assert alignments.contigs(alignments.read_header(spark, str(tmp_path / "none.bam"))).count() == 3


def test_more_operations_than_the_field_can_count():
    places, names = {"c1": 0}, ["c1"]
    n = 70_000
    row = ("long", 0, "c1", 7, 60, "1M1I" * (n // 2), "A" * n, [9] * n, [("XB", "c,1")], [("XB", "B")], None, -1, 0)
    raw = bam.pack_record(places, *row)
    assert bam.parse_record(raw[4:], names) == row


def test_failed_tasks_leave_nothing(spark, tmp_path):
    out, rows = str(tmp_path / "x.bam"), reads(200)
    sinks.write_bam(table(spark, rows[:50]), HEADER, out)
    before = sorted(os.listdir(out))

    def broken(batches):
        for batch in batches:
            yield batch
            if "r199" in batch.column("qname").to_pylist():
                raise RuntimeError("lost")

    bad = table(spark, rows).sortWithinPartitions("qname").mapInArrow(broken, READS).write.format("bam").option("header", "\n".join(HEADER))
    with pytest.raises(Exception, match="lost"):
        bad.mode("overwrite").save(out)
    assert sorted(os.listdir(out)) == before and alignments.read_alignments(spark, out).count() == 50
    with pytest.raises(Exception, match="lost"):
        bad.mode("overwrite").save(str(tmp_path / "new.bam"))
    assert not os.path.exists(tmp_path / "new.bam")
    with pytest.raises(Exception, match="has files already"):
        table(spark, rows[:3]).write.format("bam").option("header", "\n".join(HEADER)).mode("append").save(out)
    assert sorted(os.listdir(out)) == before
    with pytest.raises(Exception, match="no contig zz"):
        sinks.write_bam(table(spark, [(*rows[0][:2], "zz", *rows[0][3:])]), HEADER, out)
    assert sorted(os.listdir(out)) == before


def written(path, rows, block):
    """One file with blocks of so many bytes, and its index."""
    places, index = {n: k for k, (n, _) in enumerate(CONTIGS)}, bam.Index()
    with open(path, "wb") as f:
        out = bam.BlockWriter(f, block)
        out.write(bam.pack_header("\n".join(HEADER) + "\n", CONTIGS))
        for r in rows:
            at, raw = out.tell(), bam.pack_record(places, *r[:8], r[8].items(), r[9].items(), *r[10:])
            out.write(raw)
            if r[2] is not None:
                index.add(*bam.span_of(raw[4:]), at, out.tell())
        out.finish()
    return index.pack(len(CONTIGS))


def in_process(reader):
    return [r for p in reader.partitions() for b in reader.read(p) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]


@pytest.mark.parametrize("block", [61, 97, 256, 4000, bam.BLOCK_BYTES])
def test_every_record_once_without_an_index(tmp_path, block):
    """Blocks much smaller than records, so that records begin at every place of a block, and in few blocks at all."""
    rows, path = [r for r in reads(240, seed=block)], str(tmp_path / "x.bam")
    written(path, rows, block)
    size = os.path.getsize(path)
    for split in (size // 40 + 1, size // 7, size // 2, size * 2):
        reader = alignments.BamReader([path], split)
        pieces = reader.partitions()
        assert len(pieces) == -(-size // split)
        assert [r[0] for r in in_process(reader)] == [r[0] for r in rows]


def test_a_record_begins_at_every_place_of_a_block(tmp_path):
    """The first record of a split is found wherever it begins: names of growing length move it by one byte each."""
    base = reads(30, seed=1)
    for shift in range(0, 64):
        rows = [(f"{r[0]}{'n' * shift if k == 0 else ''}", *r[1:]) for k, r in enumerate(base)]
        path = str(tmp_path / f"{shift}.bam")
        written(path, rows, 64)
        got = in_process(alignments.BamReader([path], os.path.getsize(path) // 9))
        assert [r[0] for r in got] == [r[0] for r in rows]


def test_spark_reads_a_file_in_many_tasks(spark, tmp_path):
    rows, path = reads(500), str(tmp_path / "x.bam")
    written(path, rows, 512)
    alignments.register(spark)
    df = spark.read.format("bam").option("split", 4000).load(path)
    assert df.rdd.getNumPartitions() > 8
    assert same([plain(r) for r in df.collect()], [plain(r) for r in rows])


class Counting:
    def __init__(self, file, seen):
        self.file, self.seen = file, seen

    def __enter__(self):
        return self

    def __exit__(self, *x):
        self.file.close()

    def size(self):
        return self.file.size()

    def read(self):
        return self.file.read()

    def read_at(self, n, at):
        self.seen.append(n)
        return self.file.read_at(n, at)


def end_of(r):
    import re

    return r[3] + max(1, sum(int(n) for n, o in re.findall(r"(\d+)(.)", r[5] or "") if o in "MDN=X"))


def test_regions_read_few_bytes(tmp_path, monkeypatch):
    r, rows = random.Random(9), []
    for k in range(30_000):
        tid = 0 if k < 10_000 else 1
        pos = k * 90 if tid == 0 else (k - 10_000) * 9000
        rows.append((f"r{k}", 0, CONTIGS[tid][0], pos, r.randrange(60), "40M" if k % 5 else "10M90000N30M", "ACGT" * 10, [r.randrange(60) for _ in range(40)], {}, {}, None, -1, 0))
    path = str(tmp_path / "x.bam")
    with open(path + ".bai", "wb") as f:
        f.write(written(path, rows, 4096))
    size, seen = os.path.getsize(path), []
    monkeypatch.setattr(alignments, "_open", lambda p: Counting(bam.open_file(p), seen))

    def run(regions=None, filters=()):
        seen.clear()
        reader = alignments.BamReader([path], 1 << 20, regions=regions)
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return sorted(x[0] for x in in_process(reader)), sum(seen)

    every, whole = run()
    assert every == sorted(x[0] for x in rows) and whole >= size > 1_000_000
    few = [("c1", 16_000, 17_000), ("c2", 90_000_000, 90_400_000), ("c2", 90_300_000, 90_350_000), ("none", 0, 10)]
    over = lambda x, regions: any(x[2] == n and x[3] < b and end_of(x) > a for n, a, b in regions)
    got, used = run(few)
    assert got == sorted(x[0] for x in rows if over(x, few)) and used < size
    got, used = run(few[1:])
    assert got == sorted(x[0] for x in rows if over(x, few[1:])) and used < size / 4
    for regions in ([("c2", a, a + w)] for a in range(0, 180_000_000, 7_654_321) for w in (1, 5000, 3_000_000)):
        assert run(regions)[0] == sorted(x[0] for x in rows if over(x, regions))
    assert run([])[0] == []
    Eq, Ge, Lt = alignments.EqualTo, alignments.GreaterThanOrEqual, alignments.LessThan
    got, used = run(filters=[Eq(("rname",), "c2"), Ge(("pos",), 5_000_000), Lt(("pos",), 5_300_000), Ge(("mapq",), 20)])
    assert set(got) >= {x[0] for x in rows if x[2] == "c2" and 5_000_000 <= x[3] < 5_300_000 and x[4] >= 20} and len(got) < 36 and used < size / 2
    assert run(filters=[Eq(("mapq",), 7)])[0] == sorted(x[0] for x in rows if x[4] == 7)


def test_filters_are_pushed_and_still_right(spark, tmp_path):
    rows, out = reads(800, seed=6), str(tmp_path / "x.bam")
    sinks.write_bam(table(spark, rows), HEADER, out)
    df = alignments.read_alignments(spark, out)
    for where, want in (
        ("rname = 'c2' AND pos >= 16384 AND pos < 140000", lambda r: r[2] == "c2" and 16_384 <= r[3] < 140_000),
        ("rname IN ('c1', 'other') AND mapq > 100 AND flag <= 16", lambda r: r[2] in ("c1", "other") and r[4] > 100 and r[1] <= 16),
        ("rname IS NULL", lambda r: r[2] is None), ("pos = 0 OR flag = 99", lambda r: r[3] == 0 or r[1] == 99), ("rname = 'c1' AND rname = 'c2'", lambda r: False),
    ):
        assert sorted(r.qname for r in df.where(where).collect()) == sorted(r[0] for r in rows if want(r)), where


def test_bed_intervals_through_the_index(spark, tmp_path):
    rows, out = [r for r in reads(700, seed=8) if r[2] is not None], str(tmp_path / "x.bam")
    sinks.write_bam(table(spark, rows), HEADER, out)
    intervals = [("c1", 100, 20_000), ("c1", 15_000, 16_384), ("c2", 131_072, 150_000_000), ("other", 0, 1), ("none", 5, 6), ("c2", 9, 9)]
    bed = spark.createDataFrame(intervals, "chrom string, start long, end long")
    windows = reference.windows(bed)
    assert windows[0] == ("c1", 0, 32_768) and [w[0] for w in windows] == ["c1", "c2", "none", "other"]
    got = reference.within(alignments.read_alignments(spark, out, windows), bed).select("qname").collect()
    assert sorted(r.qname for r in got) == sorted(r[0] for r in rows if any(r[2] == c and a <= r[3] < b for c, a, b in intervals))


def test_command_line_writes_bam(spark, tmp_path, capsys):
    rng = np.random.default_rng(8)
    lines = [*HEADER]
    for k in range(250):
        n = int(rng.integers(35, 100))
        seq = "".join(rng.choice(list("ACGT"), n))
        mate = ("=", "500", "447") if k % 2 else ("c2", "9", "0") if k % 3 else ("*", "0", "0")
        lines.append("\t".join([f"r{k}", "0", "c1", str(k + 1), "37", f"{n}M", *mate, seq, "*" if k == 5 else "I" * n, f"MD:Z:{n}", "XB:B:c,1,-2", "NM:i:1"]))
    (tmp_path / "x.sam").write_text("\n".join(lines) + "\n")
    x, out, sam = str(tmp_path / "x.sam"), str(tmp_path / "out.bam"), str(tmp_path / "out.sam")
    for path in (out, sam):
        assert api.main(["-bam", x, "-ibam", x, "-obam", path, "-eps", "0.1"]) == 0
    assert "reads without qualities: 1 of 250" in capsys.readouterr().out
    first = {r.qname: r.asDict() for r in alignments.read_sam(spark, x).collect()}
    for back in (alignments.read_alignments(spark, out), alignments.read_sam(spark, sam)):
        got = {r.qname: r.asDict() for r in back.collect()}
        assert got.keys() == first.keys()
        for name, row in got.items():
            scores = {t: row["tags"].pop(t) for t in ("AN", "PD")}
            assert all(row["tag_types"].pop(t) == "f" and 0 <= float(v) <= 1 for t, v in scores.items())
            assert row == first[name]
    # and a run over what was written, of a part of the reference
    (tmp_path / "b.bed").write_text("c1 0 100\n")
    assert api.main(["-bam", out, "-bed", str(tmp_path / "b.bed"), "-oinf", str(tmp_path / "inf")]) == 0
