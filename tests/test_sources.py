import gzip
import struct
import zlib

import numpy as np
import pytest

from paleoframe import api
from paleoframe.schema import CELLS, READS, Options
from paleoframe.sources import alignments, sinks, tables

#: A small published count table (CC, CT at the 5' end; GG, GA at the 3' end), positions 1 to 15.
CC = [197, 196, 221, 203, 255, 215, 238, 223, 218, 227, 221, 231, 239, 238, 210]
CT = [64, 36, 23, 18, 17, 8, 8, 1, 3, 2, 0, 1, 1, 2, 1]
GG = [204, 206, 220, 218, 239, 243, 246, 217, 256, 215, 253, 249, 237, 213, 247]
GA = [51, 40, 32, 14, 14, 9, 5, 4, 3, 3, 1, 1, 1, 2, 2]


@pytest.fixture
def table(tmp_path):
    path = tmp_path / "table.txt.gz"
    with gzip.open(path, "wt") as f:
        f.write("\t".join(["Dir.", "Pos.", *CELLS]) + "\n")
        for end, first, changed in (("5'", CC, CT), ("3'", GG, GA)):
            for i in range(15):
                n = dict.fromkeys(CELLS, 0) | {"AA": 250, "TT": 250, "CC": 230, "GG": 230}
                n |= {"CC": first[i], "CT": changed[i]} if end == "5'" else {"GG": first[i], "GA": changed[i]}
                f.write("\t".join([end, str(i + 1), *(f"{n[c]:f}" for c in CELLS), "0", "0"]) + "\n")
    return str(path)


def test_fit_from_tables(spark, table, tmp_path):
    (tmp_path / "len.txt").write_text("100 100000\n110\t24\n130 20\n200 7\n")
    lens = {r.length: r.freq for r in tables.read_lengths(spark, str(tmp_path / "len.txt")).collect()}
    assert lens == pytest.approx({100: 100000 / 100044, 110: 24 / 100044, 130: 20 / 100044})
    got = api.fit_tables(spark, table, str(tmp_path / "len.txt")).fit
    assert 0.25 < got.x[0] < 0.45 and 0.5 < got.x[2] < 0.9 and got.x[1] < 0.02
    out = str(tmp_path / "again")
    sinks.write_mismatch_table(tables.read_mismatch_table(spark, table), out)
    same = lambda p: sorted(map(tuple, tables.read_mismatch_counts(spark, p).collect()))
    assert same(out) == same(table)
    sinks.write_fit(spark, api.fit_tables(spark, table, str(tmp_path / "len.txt")).fit, str(tmp_path / "fit"))
    assert spark.read.text(str(tmp_path / "fit")).head()[0].startswith("lambda: 0.")


def test_lengths_in_file_order(spark, tmp_path):
    (tmp_path / "len.txt").write_text("40 1\n160 5\n50 3\n170 9\n")
    got = {r.length: r.freq for r in tables.read_lengths(spark, str(tmp_path / "len.txt"), compat=True).collect()}
    assert got == {40: 0.25, 160: 1.25, 50: 0.75}


def test_rlens_and_stats(spark, tmp_path):
    with gzip.open(tmp_path / "r.gz", "wt") as f:
        f.write("id\trlen0\trlen30\trlen200\nx\t1\t2\t1\n")
    assert [tuple(r) for r in tables.read_rlens(spark, str(tmp_path / "r.gz")).collect()] == [(30, 0.5)]
    (tmp_path / "s").write_text("taxid\tnreads\ta\tb\tc\td\nchr22 1000 70.9 759.8 0.47 NA\n")
    assert tuple(tables.read_taxon_stats(spark, str(tmp_path / "s")).head()) == ("chr22", 1000, 70.9, 759.8, 0.47, None)


def test_bdamage(spark, tmp_path):
    rng = np.random.default_rng(1)
    groups = [(5, 10, rng.integers(0, 99, 240).tolist(), rng.integers(0, 99, 240).tolist()), (9, 0, [0] * 240, [0] * 240)]
    data = damage_bytes(groups)
    (tmp_path / "b.gz").write_bytes(gzip.compress(data))
    rows = tables.read_bdamage(spark, str(tmp_path / "b.gz")).collect()
    assert [(r.taxid, r.nreads, r.positions, r.fw) for r in rows] == [(5, 10, 15, [float(v) for v in groups[0][2]])]
    n = tables.bdamage_counts(tables.read_bdamage(spark, str(tmp_path / "b.gz"))).where("end = \"3'\" AND dist = 2 AND ref = 1 AND read = 3").head().n
    assert n == groups[0][3][2 * 16 + 7]
    (tmp_path / "plain").write_bytes(data)
    assert [(r.taxid, r.fw) for r in tables.read_bdamage(spark, str(tmp_path / "plain")).collect()] == [(5, [float(v) for v in groups[0][2]])]
    (tmp_path / "cut.gz").write_bytes(gzip.compress(data[:-4]))
    with pytest.raises(Exception, match="cut off"):
        tables.read_bdamage(spark, str(tmp_path / "cut.gz")).collect()


@pytest.mark.parametrize("size", [50, 977, 60_000])
def test_damage_files_in_pieces(spark, tmp_path, size):
    """Records across blocks, blocks across splits: each record once, and a cut file is an error."""
    from paleoframe.sources import bam, damage

    rng = np.random.default_rng(size)
    groups = [(k * 3, int(rng.integers(0, 3)), rng.integers(0, 9, 240).tolist(), rng.integers(0, 9, 240).tolist()) for k in range(60)]
    data = damage_bytes(groups)
    path = str(tmp_path / "x.gz")
    with open(path, "wb") as f:
        out = bam.BlockWriter(f, size)
        out.write(data)
        out.finish()
    whole = (tmp_path / "x.gz").stat().st_size
    want = sorted((k, n, fw) for k, n, fw, _ in groups)
    for split in (whole // 13, whole // 3, whole):
        df = damage.read(spark, path, split=split)
        assert df.rdd.getNumPartitions() > (3 if split < whole // 10 and size < 60_000 else 0)
        assert sorted((r.taxid, r.nreads, [int(v) for v in r.fw]) for r in df.collect()) == want
    with open(path, "wb") as f:
        out = bam.BlockWriter(f, size)
        out.write(data[:-7])
        out.finish()
    with pytest.raises(Exception, match="cut off"):
        damage.read(spark, path, split=whole // 5).collect()


def test_damage_of_many_taxa_there_and_back(spark, tmp_path):
    cells = lambda k: f"transform(sequence(0, 239), i -> CAST((id * {k} + i * 7) % 11 AS DOUBLE))"
    groups = spark.range(100_000).selectExpr("id AS taxid", "id % 50 AS n_reads", f"{cells(31)} AS fw", f"{cells(13)} AS bw")
    out = str(tmp_path / "many")
    sinks.write_bdamage(groups, "taxid", out)
    mark = ["count(*) AS n", "sum(CAST(xxhash64(CAST(taxid AS INT), CAST(n AS INT), fw, bw) AS DECIMAL(38, 0))) AS h"]
    want = groups.where("n_reads > 0").withColumnRenamed("n_reads", "n").selectExpr(*mark).head()
    back = tables.read_bdamage(spark, out, split=1 << 20)
    assert back.withColumnRenamed("nreads", "n").selectExpr(*mark).head() == want and want.n == 98_000


def damage_bytes(groups):
    """A number of positions, then records: taxon, reads, 15 x 16 numbers an end."""
    return struct.pack("<i", 15) + b"".join(struct.pack("<ii480f", taxid, n, *fw, *bw) for taxid, n, fw, bw in groups)


def bam(records):
    out = [b"BAM\x01", struct.pack("<i", 0), struct.pack("<i", 1), struct.pack("<i", 3), b"c1\0", struct.pack("<i", 1000)]
    for name, flag, pos, cigar, seq, qual, md in records:
        ops = [(n << 4) | alignments.CIGAR_OPS.index(o) for o, n in cigar]
        packed = bytearray()
        codes = [alignments.NIBBLES.index(c) for c in seq] + [0] * (len(seq) % 2)
        for a, b in zip(codes[::2], codes[1::2], strict=True):
            packed.append(a << 4 | b)
        tags = b"MDZ" + md.encode() + b"\0" + b"NMC\x01" + b"XBBc" + struct.pack("<ibb", 2, 1, -2)
        body = struct.pack("<iiBBHHHiiii", 0, pos, len(name) + 1, 37, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
        body += struct.pack(f"<{len(ops)}I", *ops) + bytes(packed) + bytes(qual) + tags
        out += [struct.pack("<i", len(body)), body]
    return b"".join(out)


def test_bam_and_sam_give_the_same_rows(spark, tmp_path):
    records = [("r1", 0, 4, [("M", 5)], "ACGTN", [30] * 5, "5"), ("r2", 16, 9, [("S", 1), ("M", 3)], "ACGT", [20, 21, 22, 23], "1A1")]
    (tmp_path / "x.bam").write_bytes(gzip.compress(bam(records)[:40]) + gzip.compress(bam(records)[40:]) + alignments.LAST_BLOCK)
    (tmp_path / "cut.bam").write_bytes(gzip.compress(bam(records)))
    lines = ["@HD\tVN:1.6"]
    for name, flag, pos, cigar, seq, qual, md in records:
        c = "".join(f"{n}{o}" for o, n in cigar)
        lines.append("\t".join([name, str(flag), "c1", str(pos + 1), "37", c, "*", "0", "0", seq, "".join(chr(q + 33) for q in qual), f"MD:Z:{md}", "NM:i:1", "XB:B:c,1,-2"]))
    (tmp_path / "x.sam").write_text("\n".join(lines) + "\n")
    a = alignments.read_alignments(spark, str(tmp_path / "x.bam")).orderBy("qname").collect()
    b = alignments.read_alignments(spark, str(tmp_path / "x.sam")).orderBy("qname").collect()
    assert [r.asDict() for r in a] == [r.asDict() for r in b]
    with pytest.raises(ValueError):
        alignments.read_alignments(spark, "x.cram")
    with pytest.raises(Exception, match="cut off"):
        alignments.read_alignments(spark, str(tmp_path / "cut.bam")).count()
    assert spark.read.format("bam").option("complete", "false").load(str(tmp_path / "cut.bam")).count() == 2
    found = alignments.contigs(alignments.read_header(spark, str(tmp_path / "x.bam"))).collect()
    assert [tuple(r) for r in found] == [("c1", 1000)]


def block(data):
    """A BGZF block: a gzip member that tells its size."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    head = bytes.fromhex("1f8b08040000000000ff0600424302") + b"\0" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def test_an_indexed_bam_is_split(spark, tmp_path):
    records = [(f"r{k}", 0, k, [("M", 40)], "ACGT" * 10, [30] * 40, "40") for k in range(300)]
    data, place = bam(records), {}
    first = data.index(b"c1\0") + 7
    at, starts = first, []
    while at < len(data):
        starts.append(at)
        at += 4 + struct.unpack_from("<i", data, at)[0]
    out = b""
    for k in range(0, len(data), 1000):  # records lie across blocks
        for s in starts:
            if k <= s < k + 1000:
                place[s] = len(out) << 16 | (s - k)
        out += block(data[k : k + 1000])
    (tmp_path / "x.bam").write_bytes(out + alignments.LAST_BLOCK)
    chosen = [place[s] for s in starts[::7]]
    index = b"BAI\x01" + struct.pack("<iiIiQQIiQQi", 1, 2, 4681, 1, chosen[0], chosen[-1], 37450, 1, 5, 9, len(chosen)) + struct.pack(f"<{len(chosen)}Q", *chosen)
    (tmp_path / "x.bam.bai").write_bytes(index)
    alignments.register(spark)
    df = spark.read.format("bam").option("split", 800).load(str(tmp_path / "x.bam"))
    assert df.rdd.getNumPartitions() > 3 and sorted(r.pos for r in df.select("pos").collect()) == list(range(300))


def test_reads_are_neither_lost_nor_multiplied(spark):
    chunks = spark.createDataFrame([("c", 0, "ACGT" * 50)], "rname string, chunk_id long, seq string")
    seq = "ACGT" * 10
    rows = [("r", 0, "c", 4, 37, c, seq, [30] * 40, {}, {}, None, -1, 0) for c in ("40M", "30M10S", "40M")]
    reads = spark.createDataFrame(rows, READS)
    got = api.align(reads, chunks).collect()
    assert sorted(r.cigar for r in got) == ["30M10S", "40M", "40M"]
    assert all(list(r.ref[:30]) == [0, 1, 2, 3] * 7 + [0, 1] for r in got)
    other = spark.createDataFrame([("r", 0, "d", 4, 37, "40M", seq, [30] * 40, {}, {}, None, -1, 0)], READS)
    with pytest.raises(Exception, match="no reference at d:4"):
        api.align(reads.unionByName(other), chunks).collect()


def test_command_line_writes_alignments(spark, tmp_path, capsys):
    rng = np.random.default_rng(8)
    lines = ["@HD\tVN:1.6", "@SQ\tSN:c1\tLN:9000"]
    for k in range(300):
        n = int(rng.integers(35, 100))
        seq = "".join(rng.choice(list("ACGT"), n))
        at = seq.find("T")
        md = f"{at}C{n - at - 1}" if k % 3 == 0 and 0 <= at < 8 else str(n)
        lines.append("\t".join([f"r{k}", "0", "c1", str(k + 1), "37", f"{n}M", "*", "0", "0", seq, "*" if k == 5 else "I" * n, f"MD:Z:{md}", "XB:B:c,1,-2", "NM:i:1"]))
    (tmp_path / "x.sam").write_text("\n".join(lines) + "\n")
    x, out = str(tmp_path / "x.sam"), str(tmp_path / "out.sam")
    assert api.main(["-bam", x, "-ibam", x, "-obam", out, "-eps", "0.1", "-olen", str(tmp_path / "len"), "-oinf", str(tmp_path / "inf"), "-otab", str(tmp_path / "tab")]) == 0
    said = capsys.readouterr().out
    assert "5' C>T:" in said and "lambda: " in said
    back = alignments.read_sam(spark, out).orderBy("pos").collect()
    first = alignments.read_sam(spark, x).orderBy("pos").collect()
    same = ("qname", "flag", "rname", "pos", "mapq", "cigar", "seq", "qual")
    assert [[r[c] for c in same] for r in back] == [[r[c] for c in same] for r in first]
    for a, b in zip(back, first, strict=True):
        assert {k: v for k, v in a.tags.items() if k not in sinks.TAGS} == b.tags and a.tag_types["XB"] == "B" and a.tag_types["AN"] == "f"
        assert 0 <= float(a.tags["AN"]) <= 1 and 0 <= float(a.tags["PD"]) <= 1
    assert [tuple(r) for r in alignments.contigs(alignments.read_header(spark, out)).distinct().collect()] == [("c1", 9000)]
    assert [r.value for r in spark.read.text(str(tmp_path / "len")).collect()][0].split("\t")[0] == "35"
    assert spark.read.text(str(tmp_path / "tab")).count() == 31 and spark.read.text(str(tmp_path / "inf")).head()[0].startswith("lambda")


def test_fasta_and_whole_run(spark, tmp_path):
    rng = np.random.default_rng(3)
    genome = "".join(rng.choice(list("ACGT"), 5000))
    lines = [genome[i : i + 60] for i in range(0, 5000, 60)]
    (tmp_path / "g.fa").write_text(">c1\n" + "\n".join(lines) + "\n")
    (tmp_path / "g.fa.fai").write_text("c1\t5000\t4\t60\t61\n")
    alignments.register(spark)
    chunks = spark.read.format("fasta").option("chunk", 1 << 16).load(str(tmp_path / "g.fa"))
    assert "".join(r.seq for r in chunks.orderBy("chunk_id").collect()) == genome
    rows, other = [], {"A": "T", "C": "G", "G": "C", "T": "A"}
    for k in range(400):
        n, p = int(rng.integers(35, 120)), int(rng.integers(0, 4800))
        ref = genome[p : p + n]
        n, flag = len(ref), int(rng.choice([0, 16]))
        mol = ref if flag == 0 else "".join(other[c] for c in reversed(ref))
        mol = "".join("T" if c == "C" and rng.random() < 0.5 * 0.7**i + 0.02 else "A" if c == "G" and rng.random() < 0.5 * 0.7 ** (n - 1 - i) + 0.02 else c for i, c in enumerate(mol))
        seq = mol if flag == 0 else "".join(other[c] for c in reversed(mol))
        rows.append((f"r{k}", flag, "c1", p, 37, f"{n}M", seq, [35] * n, {}))
    reads = spark.createDataFrame(rows, "qname string, flag int, rname string, pos long, mapq int, cigar string, seq string, qual array<int>, tags map<string,string>")
    o = Options(eps=0.1, isrecal=1)
    aligned = api.align(reads, chunks, o).cache()
    fitted, scored = api.run(aligned, o)
    got = scored.collect()
    assert len(got) == 400 and all(0 <= r.AN <= 1 and 0 <= r.AO <= 1 and 0 <= r.PD <= 1 for r in got)
    assert fitted.fit.x[2] > 0.3 and sum(r.AO for r in got) / 400 > 0.6


def test_damage_files_by_group(spark, tmp_path):
    rows = [(7, "5'", 0, 1, 3, 4), (7, "5'", 0, 1, 1, 6), (7, "3'", 14, 2, 0, 5), (8, "3'", 1, 0, 0, 2)]
    counts = spark.createDataFrame(rows, "taxid int, end string, dist int, ref int, read int, n long")
    n = spark.createDataFrame([(7, 3), (8, 1), (9, 0)], "taxid int, n_reads int")
    groups = sinks.damage_groups(counts, "taxid", n)
    sinks.write_bdamage(groups, "taxid", str(tmp_path / "d.gz"))
    back = tables.bdamage_counts(tables.read_bdamage(spark, str(tmp_path / "d.gz"))).where("n > 0")
    assert sorted((r.taxid, r.end, r.dist, r.ref, r.read, int(r.n)) for r in back.collect()) == sorted(rows)
    assert {len(r.value.split("\t")) for r in sinks.group_lines(groups, "taxid").collect()} == {2 + 2 * 240}
    from paleoframe.operators.profile import substitution_rates

    lines = {r.line: r.text.split("\t") for r in sinks.rate_lines(substitution_rates(counts.where("taxid = 7").drop("taxid"))).collect()}
    assert lines[0][5] == "0.400000" and lines[29][6] == "1.000000"


def test_summary_of_more_positions_than_stored(spark, tmp_path):
    rows = spark.createDataFrame([(3, 2, 4, [float(k % 7) for k in range(64)], [1.0] * 64)], "taxid int, nreads int, positions int, fw array<double>, bw array<double>")
    got = {r.dist: r for r in tables.bdamage_summary(rows, 4).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    # C at the 5' end of position 0 is read as 4, 5, 6, 0; G at the 3' end as 1 each
    assert got[0].ct == 0 and got[0].ga == pytest.approx(2 * 0.25)
    with pytest.raises(Exception, match="5 positions asked for, stored are 4"):
        tables.bdamage_summary(rows, 5).collect()
