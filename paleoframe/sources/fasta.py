"""FASTA files as chunks of sequence: plain or in gzip blocks, with or without an index.

Where a file has no .fai, one pass of many tasks describes the lines that begin in each split, and the contigs follow from
the splits in order. Where a compressed file has no .gzi, a pass before lists its blocks. Both are small next to the file:
a row for each contig and split, a pair for each block.
"""

from __future__ import annotations

import json
import struct
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .bam import Blocks, block_size, next_block, open_file
from .parts import filesystem

CHUNK, SPLIT_BYTES = 1 << 16, 32 << 20


class Unpacked:
    """Any bytes of a file by their places in what it unpacks to. blocks: (place in the file, place unpacked) of each block, in
    order, or None for a plain file."""

    def __init__(self, file, blocks: list | None):
        self.file, self.blocks = file, blocks
        self.begins = [u for _, u in blocks or ()]

    def read_at(self, n: int, at: int) -> bytes:
        if self.blocks is None:
            return self.file.read_at(max(0, min(n, self.file.size() - at)), at)
        k = max(0, bisect_right(self.begins, at) - 1)
        last = min(len(self.blocks) - 1, bisect_right(self.begins, at + n) + 1)
        stream = Blocks(self.file, self.blocks[k][0] << 16, self.blocks[last][0] << 16 | 1)
        stream.read(at - self.begins[k])
        return stream.read(n)


def read_gzi(data: bytes) -> list[tuple[int, int]]:
    n = struct.unpack_from("<Q", data)[0]
    flat = struct.unpack_from(f"<{2 * n}Q", data, 8)
    return [(0, 0), *zip(flat[::2], flat[1::2], strict=True)]


def list_blocks(file, begin: int, end: int) -> list[tuple[int, int]]:
    """(place, unpacked size) of the blocks that begin in [begin, end)."""
    out, at, size = [], next_block(file, begin), file.size()
    while at is not None and at < min(end, size):
        n = block_size(file.read_at(min(18, size - at), at))
        if not n or at + n > size:
            raise ValueError(f"no block at {at}: the file is cut off")
        out.append((at, struct.unpack("<I", file.read_at(4, at + n - 4))[0]))
        at += n
    return out


def describe(data: Unpacked, begin: int, end: int) -> list[tuple]:
    """Runs of the lines that begin in [begin, end): (name or None, place of its first sequence line, lines, bases, bases
    and width of the first line, bases of the last, whether all but the last are like the first). A run ends at a header."""
    if begin:  # a line that began before is not this split's
        while begin < end and data.read_at(1, begin - 1) != b"\n":
            part = data.read_at(min(1 << 16, end - begin), begin)
            cut = part.find(b"\n")
            begin += cut + 1 if cut >= 0 else max(1, len(part))
        if begin >= end:
            return []
    raw = data.read_at(end - begin, begin)
    while raw and not raw.endswith(b"\n") and (more := data.read_at(1 << 16, begin + len(raw))):
        cut = more.find(b"\n")
        raw += more[: cut + 1] if cut >= 0 else more
    if not raw:
        return []
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    if not len(ends) or ends[-1] < len(raw):
        ends = np.append(ends, len(raw))
    starts = np.concatenate([[0], ends[:-1]])
    bytes_ = np.frombuffer(raw, np.uint8)
    header = bytes_[starts] == ord(">")
    last = bytes_[ends - 1] == 10
    returned = last & (ends - starts > 1) & (bytes_[np.maximum(ends - 2, 0)] == 13)
    width = ends - starts
    bases = width - last - returned
    out = []
    cuts = np.flatnonzero(header)
    for i, j in zip([-1, *cuts], [*cuts, len(starts)], strict=True):
        name = raw[starts[i] + 1 : ends[i]].split()[0].decode() if i >= 0 else None
        own = slice(i + 1, j)
        n, b, w = j - i - 1, bases[own], width[own]
        if i < 0 and not n:
            continue
        alike = bool(n == 0 or ((b[:-1] == b[0]) & (w[:-1] == w[0])).all())
        place = int(begin + (ends[i] if i >= 0 else starts[0]))
        out.append((name, place, int(n), int(b.sum()), int(b[0]) if n else 0, int(w[0]) if n else 0, int(b[-1]) if n else 0, alike))
    return out


def contigs_of(runs: list[tuple]) -> list[tuple]:
    """name, length, offset, bases and width of a line, as of an index, from the runs of all splits in order."""
    out: list[list] = []
    for name, place, n, total, first, width, last, alike in runs:
        if name is not None:
            out.append([name, 0, place, 0, 0, True])
        elif not out:
            raise ValueError("a FASTA file begins with a header")
        c = out[-1]
        if not n:
            continue
        if not c[4]:
            c[3], c[4] = first, width
        # a line that is not like the first has to be the contig's last one, and shorter
        if not c[5] or not alike or (n > 1 and first != c[3]) or first > c[3] or last > c[3]:
            raise ValueError(f"lines of {c[0]} differ in length")
        c[5] = last == c[3]
        c[1] += total
    return [tuple(c[:5]) for c in out]


def index(spark: SparkSession, path: str, split: int = SPLIT_BYTES) -> tuple[list[tuple], list | None]:
    """The rows of a .fai and the blocks (None for a plain file): of the files beside ``path`` or made from it."""
    fs, place = filesystem(path)
    size = fs.get_file_info(place).size
    with open_file(path) as f:
        head = f.read_at(min(18, size), 0)

    def beside(suffix):
        try:
            with open_file(path + suffix) as f:
                return f.read()
        except FileNotFoundError:
            return None

    def over(splits, work, schema):
        """Rows of work(file, begin, end) for all splits, in their order."""

        def run(frames):
            import pandas as pd

            for frame in frames:
                rows = []
                for k, a, b in frame.itertuples(index=False):
                    with open_file(path) as f:
                        rows += [(k, i, *r) for i, r in enumerate(work(f, int(a), int(b)))]
                yield pd.DataFrame(rows, columns=["k", "i", *(c.split()[0] for c in schema.split(", "))])

        table = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(splits)], "k long, a long, b long").repartition(len(splits), "k")
        return [tuple(r[2:]) for r in sorted(table.mapInPandas(run, f"k long, i long, {schema}").collect(), key=lambda r: (r[0], r[1]))]

    cuts = lambda n: [(a, min(a + split, n)) for a in range(0, max(n, 1), split)]
    blocks, total = None, size
    if head[:2] == b"\x1f\x8b":
        if not block_size(head):
            raise ValueError(f"{path}: compressed, but not in blocks")
        gzi = beside(".gzi")
        if gzi is not None:
            blocks = read_gzi(gzi)
        else:
            found = over(cuts(size), list_blocks, "place long, n long")
            blocks, u = [], 0
            for at, n in found:
                blocks.append((at, u))
                u += n
        with open_file(path) as f:
            tail = list_blocks(f, blocks[-1][0], size)
        total = blocks[-1][1] + sum(n for _, n in tail)
    fai = beside(".fai")
    if fai is not None:
        rows = [(x[0], *map(int, x[1:5])) for x in (line.split("\t") for line in fai.decode().splitlines())]
    else:
        schema = "name string, place long, n long, total long, first long, width long, last long, alike boolean"
        rows = contigs_of(over(cuts(total), lambda f, a, b: describe(Unpacked(f, blocks), a, b), schema))
    return rows, blocks


class FastaReader(DataSourceReader):
    def __init__(self, path: str, chunk: int, rows: list, blocks: list | None):
        self.path, self.chunk, self.rows, self.blocks = path, chunk, rows, blocks

    def partitions(self):
        per = self.chunk * 256
        return [InputPartition((name, a, min(a + per, length), offset, bases, width)) for name, length, offset, bases, width in self.rows for a in range(0, length, per)]

    def read(self, partition):
        name, begin, end, offset, bases, width = partition.value
        place = lambda i: offset + i // bases * width + i % bases
        with open_file(self.path) as f:
            data = Unpacked(f, self.blocks)
            for a in range(begin, end, self.chunk):
                b = min(a + self.chunk, end)
                got = data.read_at(place(b - 1) + 1 - place(a), place(a))
                yield name, a // self.chunk, got.replace(b"\n", b"").replace(b"\r", b"").decode().upper()


class FastaSource(DataSource):
    """Chunks of a FASTA file: rname, chunk_id, seq. Options chunk (bases a chunk), and rows and blocks (JSON, of ``index``; without
    them a plain file with a .fai)."""

    @classmethod
    def name(cls):
        return "fasta"

    def schema(self):
        return "rname string, chunk_id long, seq string"

    def reader(self, schema):
        path, rows, blocks = self.options["path"], self.options.get("rows"), self.options.get("blocks")
        if rows is None:
            with open_file(path + ".fai") as f:
                rows = json.dumps([(x[0], *map(int, x[1:5])) for x in (line.split("\t") for line in f.read().decode().splitlines())])
        return FastaReader(path, int(self.options.get("chunk", CHUNK)), json.loads(rows), blocks and json.loads(blocks))


def read(spark: SparkSession, path: str, chunk: int = CHUNK, split: int = SPLIT_BYTES) -> DataFrame:
    """rname, chunk_id, seq of a FASTA file, indexed or not, plain or in blocks."""
    spark.dataSource.register(FastaSource)
    rows, blocks = index(spark, path, split)
    source = spark.read.format("fasta").option("chunk", chunk).option("rows", json.dumps(rows))
    return (source if blocks is None else source.option("blocks", json.dumps(blocks))).load(path)
