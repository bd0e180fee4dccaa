"""Per-taxon damage files: a number of positions, then records of one size, in gzip blocks.

A file of blocks that tell their sizes is read by many tasks. What a task's bytes unpack to is known only after those before
it, so a first pass sums the unpacked sizes of the blocks of every split, and a split's records follow from the sum of all
before it. Files are written as parts, each a complete file.
"""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import POSITIONS
from .bam import Blocks, BlockWriter, block_size, next_block, open_file
from .parts import Part, PartsWriter, files, filesystem

BDAMAGE = "taxid int, nreads int, positions int, fw array<double>, bw array<double>"
#: Compressed bytes of one task; records of one batch; bytes of a block that is written.
SPLIT_BYTES, ROWS = 32 << 20, 500


def record_type(positions: int, kind: str = "f4") -> np.dtype:
    """kind f4 or i4: what the cells are stored as."""
    if positions <= 0:
        raise ValueError("not a damage file")
    return np.dtype([("taxid", "<i4"), ("n", "<i4"), ("fw", f"<{kind}", 16 * positions), ("bw", f"<{kind}", 16 * positions)])


def records_batch(records: np.ndarray, positions: int) -> pa.RecordBatch:
    n, width = len(records), 16 * positions
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width)
    lists = [pa.ListArray.from_arrays(offsets, pa.array(records[c].astype(float).ravel())) for c in ("fw", "bw")]
    return pa.RecordBatch.from_arrays(
        [pa.array(records["taxid"]), pa.array(records["n"]), pa.array(np.full(n, positions, np.int32)), *lists], [c.split()[0] for c in BDAMAGE.split(", ")]
    )


def unpacked_bytes(file, begin: int, end: int) -> tuple[int, int]:
    """The first block that begins in [begin, end) (-1: none), and what all of these unpack to."""
    at = next_block(file, begin)
    if at is None or at >= end:
        return -1, 0
    first, total, size = at, 0, file.size()
    while at < min(end, size):
        n = block_size(file.read_at(min(18, size - at), at))
        if not n or at + n > size:
            raise ValueError("not a damage file, or one that is cut off")
        total += struct.unpack("<I", file.read_at(4, at + n - 4))[0]
        at += n
    return first, total


@dataclass
class Piece(InputPartition):
    """Of a file: the records that begin in [begin, end) of its unpacked bytes (end -1: all), of which the block at the byte
    ``at`` has the first, ``begin``. kind of file: blocks, or plain."""

    path: str
    at: int
    begin: int
    end: int
    packed: bool

    def __init__(self, path, at, begin, end, packed):
        self.path, self.at, self.begin, self.end, self.packed = path, at, begin, end, packed


class _Plain:
    def __init__(self, file, at):
        self.file, self.at = file, at

    def read(self, n):
        out = self.file.read_at(min(n, self.file.size() - self.at), self.at) if self.at < self.file.size() else b""
        self.at += len(out)
        return out


class DamageReader(DataSourceReader):
    def __init__(self, pieces: list[Piece], kind: str):
        self.pieces, self.kind = pieces, kind

    def partitions(self):
        return self.pieces

    def read(self, p):
        with open_file(p.path) as file:
            stream = (lambda at: Blocks(file, at << 16)) if p.packed else (lambda at: _Plain(file, at))
            head = stream(0).read(4)
            if len(head) < 4:
                raise ValueError(f"{p.path}: not a damage file")
            positions = struct.unpack("<i", head)[0]
            record = record_type(positions, self.kind)
            size = record.itemsize
            start = 4 + max(0, -(-(p.begin - 4) // size)) * size
            own = stream(p.at)
            own.read(start - p.begin)
            while p.end < 0 or start < p.end:
                n = ROWS if p.end < 0 else min(ROWS, -(-(p.end - start) // size))
                data = own.read(n * size)
                if len(data) % size or (p.end >= 0 and len(data) < n * size):
                    raise ValueError(f"{p.path}: the file is cut off")
                if not data:
                    break
                yield records_batch(np.frombuffer(data, record), positions)
                start += len(data)


class DamageWriter(PartsWriter):
    """Rows taxid, nreads, fw, bw as complete damage files with POSITIONS positions."""

    suffix = ".bdamage.gz"

    def write(self, iterator):
        out, record = None, record_type(POSITIONS)
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                fs, name, place = self.part()
                file = fs.open_output_stream(place, compression=None)
                out = BlockWriter(file)
                out.write(struct.pack("<i", POSITIONS))
            rows = np.zeros(batch.num_rows, record)
            rows["taxid"], rows["n"] = batch.column("taxid").to_numpy(), batch.column("nreads").to_numpy()
            for c in ("fw", "bw"):
                rows[c] = batch.column(c).flatten().to_numpy().reshape(-1, 16 * POSITIONS)
            out.write(rows.tobytes())
        if out is None:
            return Part([])
        out.finish()
        file.close()
        return Part([name])

    def empty(self, file):
        out = BlockWriter(file)
        out.write(struct.pack("<i", POSITIONS))
        out.finish()


class DamageSource(DataSource):
    """Options pieces (JSON, of ``read``) and kind to read; a path to write."""

    @classmethod
    def name(cls):
        return "bdamage"

    def schema(self):
        return BDAMAGE

    def reader(self, schema):
        return DamageReader([Piece(*p) for p in json.loads(self.options["pieces"])], self.options.get("kind", "f4"))

    def writer(self, schema, overwrite):
        return DamageWriter(self.options["path"], overwrite)


def read(spark: SparkSession, path: str, kind: str = "f4", split: int = SPLIT_BYTES) -> DataFrame:
    """BDAMAGE rows of a file or a folder of parts, all records."""
    spark.dataSource.register(DamageSource)
    pieces, splits = [], []
    for name in files([path], DamageWriter.suffix):
        fs, place = filesystem(name)
        size = fs.get_file_info(place).size
        with open_file(name) as f:
            head = f.read_at(min(18, size), 0)
        if block_size(head) and size > split:
            splits += [(len(splits) + k, name, a, min(a + split, size)) for k, a in enumerate(range(0, size, split))]
        else:
            pieces.append((name, 0, 0, -1, head[:2] == b"\x1f\x8b"))
    if splits:

        def run(frames):
            import pandas as pd

            for frame in frames:
                out = []
                for k, name, a, b in frame.itertuples(index=False):
                    with open_file(name) as f:
                        out.append((k, *unpacked_bytes(f, int(a), int(b))))
                yield pd.DataFrame(out, columns=["k", "first", "n"])

        table = spark.createDataFrame(splits, "k long, path string, a long, b long").repartition(len(splits), "k")
        sums = {r["k"]: (r["first"], r["n"]) for r in table.mapInPandas(run, "k long, first long, n long").collect()}
        before: dict[str, int] = {}
        for k, name, _, _ in splits:
            first, n = sums[k]
            begin = before.get(name, 0)
            before[name] = begin + n
            if n:
                pieces.append((name, first, begin, begin + n, True))
    return spark.read.format("bdamage").option("pieces", json.dumps(pieces)).option("kind", kind).load()


def write(groups: DataFrame, by: str, path: str) -> None:
    """groups (by, n_reads, fw, bw) as a folder of damage files in the order of ``by``; groups without reads are left out."""
    spark = groups.sparkSession
    spark.dataSource.register(DamageSource)
    rows = groups.where("n_reads > 0").selectExpr(f"CAST(`{by}` AS INT) AS taxid", "CAST(n_reads AS INT) AS nreads", "CAST(fw AS ARRAY<DOUBLE>) AS fw", "CAST(bw AS ARRAY<DOUBLE>) AS bw")
    rows.repartitionByRange("taxid").sortWithinPartitions("taxid").write.format("bdamage").mode("overwrite").save(path)
