"""How often a run goes over the reads, and that the summary of one pass is what the single operators give."""

import numpy as np
import pytest

from paleoframe import api
from paleoframe.operators import lengths as OL
from paleoframe.operators import profile as OP
from paleoframe.operators import reads as OR
from paleoframe.schema import Options
from paleoframe.sources import alignments, sinks


def rows_of(n=400):
    rng = np.random.default_rng(21)
    out = []
    for k in range(n):
        size = int(rng.choice([12, 30, 31, 45, 90, 149, 150]))
        ref = rng.integers(0, 5, size).tolist()
        read = [int(rng.integers(0, 5)) if rng.random() < 0.1 else r for r in ref]
        flag = int(rng.choice([0, 16, 1, 256, 272, 1024]))
        qual = [255] * size if k % 9 == 0 else rng.integers(2, 41, size).tolist()
        out.append((k, flag, size, ref, read, qual))
    return out


@pytest.fixture(scope="module")
def aligned(spark):
    return spark.createDataFrame(rows_of(), "read_id long, flag int, length int, ref array<int>, read array<int>, qual array<int>").cache()


@pytest.mark.parametrize("o", [Options(), Options(len_limit=0), Options(min_quality=20), Options(single_end=False)])
def test_one_summary_has_all_counts(aligned, o):
    summary = OP.read_summary(aligned, o).cache()
    reads = OR.eligible(aligned, o)
    same = lambda a, b: sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect()))
    assert same(OP.summary_counts(summary), OP.mismatch_counts(OR.end_bases(reads, min_quality=o.min_quality)))
    assert same(OP.summary_lengths(summary), OL.length_histogram(reads))
    want = sum(r.qual[0] == 255 for r in reads.collect())
    assert sum(r.lacking for r in summary.collect()) == want > 0


def counted(df, path):
    """``df``, noting in a file how many rows each pass reads."""

    def run(batches):
        for batch in batches:
            with open(path, "a") as f:
                f.write(f"{batch.num_rows}\n")
            yield batch

    return df.mapInArrow(run, df.schema)


def passes(path, n):
    total = sum(map(int, path.read_text().split())) if path.exists() else 0
    path.unlink(missing_ok=True)
    assert total % n == 0
    return total // n


def test_a_fit_is_one_pass(spark, aligned, tmp_path):
    note = tmp_path / "rows"
    df = counted(aligned, str(note))
    fitted = api.fit_reads(df, Options(eps=0.1))
    assert passes(note, 400) == 1
    sinks.write_mismatch_table(fitted.wide, str(tmp_path / "tab"))
    sinks.write_lengths(fitted.lengths, str(tmp_path / "len"))
    OP.profile(fitted.wide).collect()
    assert passes(note, 400) == 0
    assert api.score(df, fitted, Options(eps=0.1)).count() == fitted.n_reads
    assert passes(note, 400) == 1


def test_a_run_of_the_command_line_is_one_pass_and_one_for_scores(spark, tmp_path, monkeypatch):
    rng, lines, note = np.random.default_rng(8), ["@HD\tVN:1.6", "@SQ\tSN:c1\tLN:9000"], tmp_path / "rows"
    for k in range(200):
        n = int(rng.integers(35, 100))
        lines.append("\t".join([f"r{k}", "0", "c1", str(k + 1), "37", f"{n}M", "*", "0", "0", "".join(rng.choice(list("ACGT"), n)), "I" * n, f"MD:Z:{n}"]))
    (tmp_path / "x.sam").write_text("\n".join(lines) + "\n")
    read = alignments.read_alignments
    monkeypatch.setattr(alignments, "read_alignments", lambda spark, path: counted(read(spark, path), str(note)))
    x = str(tmp_path / "x.sam")
    out = [z for name in ("otab", "olen", "oinf") for z in (f"-{name}", str(tmp_path / name))]
    assert api.main(["-bam", x, "-eps", "0.1", *out]) == 0
    assert passes(note, 200) == 1
    assert api.main(["-bam", x, "-eps", "0.1", *out, "-ibam", x, "-obam", str(tmp_path / "out.sam")]) == 0
    assert passes(note, 200) == 2
