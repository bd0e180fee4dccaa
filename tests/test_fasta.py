"""FASTA files with and without indexes, plain and compressed, give the same chunks."""

import os
import random
import struct

import pytest

from paleoframe.sources import bam, fasta


def contigs(seed, n=7):
    r = random.Random(seed)
    return [(f"c{k}", "".join(r.choice("ACGTNacgt") for _ in range(r.choice([1, 59, 60, 61, 120, 1234, 5000])))) for k in range(n)]


def text(own, width=60, end="\n", last=True):
    out = "".join(f">{n} some words{end}" + "".join(s[i : i + width] + end for i in range(0, len(s), width)) for n, s in own)
    return out if last else out[: -len(end)]


def chunks(own, size):
    return sorted((n, i // size, s[i : i + size].upper()) for n, s in own for i in range(0, len(s), size))


def compressed(path, data, block):
    places = []
    with open(path, "wb") as f:
        out = bam.BlockWriter(f, block)
        for i in range(0, len(data), block):
            places.append((out.gone, i))
            out.write(data[i : i + block])
        out.finish()
    return places


def fai(own, width=60):
    rows, at = [], 0
    for n, s in own:
        at += len(f">{n} some words\n")
        rows.append(f"{n}\t{len(s)}\t{at}\t{min(width, len(s))}\t{min(width, len(s)) + 1}")
        at += len(s) + -(-len(s) // width)
    return "\n".join(rows) + "\n"


@pytest.mark.parametrize("end, last", [("\n", True), ("\n", False), ("\r\n", True)])
def test_an_index_from_any_splits(end, last):
    """In process: wherever splits lie, in lines, at their ends or in headers."""
    own = contigs(1)
    data = text(own, end=end, last=last).encode()

    class File:
        def size(self):
            return len(data)

        def read_at(self, n, at):
            return data[at : at + n]

    want = None
    for split in (len(data), 4096, 257, 61, 60, 7, 1):
        runs = [r for a in range(0, len(data), split) for r in fasta.describe(fasta.Unpacked(File(), None), a, min(a + split, len(data)))]
        rows = fasta.contigs_of(runs)
        assert [(r[0], r[1]) for r in rows] == [(n, len(s)) for n, s in own]
        want = want or rows
        assert rows == want
    if end == "\n" and last:
        assert "".join("\t".join(map(str, r)) + "\n" for r in want) == fai(own)


def test_lines_of_different_lengths_are_an_error(spark, tmp_path):
    for bad in (">a\nACGT\nAC\nACGT\n", ">a\nAC\nACGT\n", "ACGT\n", ">a\nACGT\n\nACGT\n"):
        (tmp_path / "bad.fa").write_text(bad)
        for split in (1, 3, 100):
            with pytest.raises(ValueError):
                fasta.index(spark, str(tmp_path / "bad.fa"), split) if split > 1 else fasta.contigs_of(
                    [r for a in range(len(bad)) for r in fasta.describe(fasta.Unpacked(_Bytes(bad.encode()), None), a, a + 1)]
                )


class _Bytes:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


def test_all_forms_give_the_chunks_of_the_plain_file(spark, tmp_path):
    own = contigs(2, 9)
    data, plain, packed = text(own).encode(), str(tmp_path / "g.fa"), str(tmp_path / "g.fa.gz")
    (tmp_path / "g.fa").write_bytes(data)
    places = compressed(packed, data, 700)
    got = lambda path, split=2000: sorted(map(tuple, fasta.read(spark, path, 512, split).collect()))
    want = chunks(own, 512)
    assert got(plain) == want and got(packed) == want and got(packed, 1 << 20) == want  # nothing beside them
    (tmp_path / "g.fa.gz.gzi").write_bytes(struct.pack("<Q", len(places) - 1) + b"".join(struct.pack("<QQ", *p) for p in places[1:]))
    assert got(packed) == want
    for path in (plain, packed):
        with open(path + ".fai", "w") as f:
            f.write(fai(own))
        assert got(path) == want
    os.remove(packed + ".gzi")
    assert got(packed) == want
    import gzip

    (tmp_path / "stream.fa.gz").write_bytes(gzip.compress(data))
    with pytest.raises(ValueError, match="not in blocks"):
        fasta.read(spark, str(tmp_path / "stream.fa.gz"))
