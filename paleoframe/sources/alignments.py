"""Alignment sources: SAM as text, BAM as a Python data source that reads byte ranges on executors and writes parts."""

from __future__ import annotations

import json
import struct
from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions.bases import CIGAR_OPS, NIBBLES  # noqa: F401
from ..schema import READS
from . import bam
from .bam import LAST_BLOCK, Blocks, parse_header, parse_record
from .fasta import FastaSource
from .parts import Part, PartsWriter, files


def _open(path: str):
    return bam.open_file(path)


def check_path(path: str) -> str:
    if ".cram" in path:
        raise ValueError(f"{path}: CRAM files are not read")
    return path


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """READS rows of SAM text, plain or gzip; positions 0-based; a missing quality string gives 255 for each base."""
    p = F.split("value", "\t")
    seq = p[9]
    qual = F.when(p[10] == "*", F.array_repeat(F.lit(255), F.length(seq))).otherwise(
        F.transform(F.split(p[10], ""), lambda c: F.ascii(c) - 33)
    )
    extra = F.slice(p, 12, 1 << 20)
    tag = lambda at, n: F.map_from_entries(F.transform(extra, lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.substring(t, at, n).alias("v"))))
    return spark.read.text(check_path(path)).where("value <> '' AND NOT startswith(value, '@')").select(
        p[0].alias("qname"), p[1].cast("int").alias("flag"), F.nullif(p[2], F.lit("*")).alias("rname"), (p[3].cast("long") - 1).alias("pos"),
        p[4].cast("int").alias("mapq"), F.nullif(p[5], F.lit("*")).alias("cigar"), F.nullif(seq, F.lit("*")).alias("seq"), qual.alias("qual"), tag(6, 1 << 30).alias("tags"), tag(4, 1).alias("tag_types"),
        F.when(p[6] == "=", F.nullif(p[2], F.lit("*"))).otherwise(F.nullif(p[6], F.lit("*"))).alias("rnext"), (p[7].cast("long") - 1).alias("pnext"), p[8].cast("int").alias("tlen"),
    )


#: Compressed bytes of one task.
SPLIT_BYTES = 64 << 20
ROWS = 2000


@dataclass
class Piece(InputPartition):
    """Of a file: the records of these chunks of virtual offsets (None: the file's first record, its end); or, without an
    index, the records that begin in blocks from one byte to before another."""

    path: str
    chunks: list
    bytes: tuple[int, int] | None = None

    def __init__(self, path, chunks, bytes=None):  # noqa: A002
        self.path, self.chunks, self.bytes = path, chunks, bytes


_COMPARE = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
_TESTS = {"==": lambda a, b: a == b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


class BamReader(DataSourceReader):
    """A partition has about ``split`` compressed bytes. An index (.bai) beside a file tells where records begin; without
    one, they are found in the bytes. A file without its last, empty block is cut off and an error, unless ``complete``
    is False.

    regions, [contig, begin, end] each: only records over these; with an index, only the bytes that hold them are read.
    Comparisons of rname, pos, mapq and flag with constants are tested before a record is unpacked, those of rname and
    pos choose bytes as regions do; Spark tests all of them again.
    """

    def __init__(self, paths: list[str], split: int = SPLIT_BYTES, complete: bool = True, regions: list | None = None):
        self.paths, self.split, self.complete, self.regions = paths, split, complete, regions
        self.tests: list[tuple] = []
        self.contigs: set | None = None
        self.low, self.high = 0, 1 << 31

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column == "rname" and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.contigs = wanted if self.contigs is None else self.contigs & wanted
            elif column in ("pos", "mapq", "flag") and type(f) in _COMPARE and f.value is not None:
                how, v = _COMPARE[type(f)], int(f.value)
                self.tests.append((column, how, v))
                if column == "pos":
                    self.low = max(self.low, {"==": v, ">": v + 1, ">=": v}.get(how, 0))
                    self.high = min(self.high, {"==": v + 1, "<": v, "<=": v + 1}.get(how, 1 << 31))
            yield f  # for Spark as well

    def _wanted(self, names: list[str], lengths: list[int]) -> list[tuple[int, int, int]] | None:
        """The regions by number of contig; None if every record may be wanted."""
        if self.regions is None and self.contigs is None:
            return None
        at = {n: k for k, n in enumerate(names)}
        every = [(n, 0, max(1, lengths[at[n]])) for n in (self.contigs or ()) if n in at] if self.regions is None else self.regions
        kept = [(at[n], max(a, self.low), min(b, self.high)) for n, a, b in every if n in at and (self.contigs is None or n in self.contigs)]
        return sorted(r for r in kept if r[1] < r[2])

    def partitions(self):
        return [piece for path in files(self.paths, ".bam") for piece in self._pieces(path)] or [Piece("", [])]

    def _pieces(self, path: str):
        index = None
        for name in (path + ".bai", path.removesuffix(".bam") + ".bai"):
            try:
                with _open(name) as f:
                    index = bam.Index.parse(f.read())
                break
            except FileNotFoundError:
                continue
        with _open(path) as file:
            size, blocks = file.size(), bam.block_size(file.read_at(min(18, file.size()), 0)) > 0
            wanted = None
            if index and (self.regions is not None or self.contigs is not None):
                contigs = parse_header(Blocks(file, 0, 0))[1]
                wanted = self._wanted([n for n, _ in contigs], [n for _, n in contigs])
        if wanted is not None:
            held, out = 0, [[]]
            for a, b in index.chunks(wanted):
                if held >= self.split:
                    out.append([])
                    held = 0
                out[-1].append((a, b))
                held += (b >> 16) - (a >> 16) + 1
            return [Piece(path, chunks) for chunks in out if chunks]
        if index:
            cuts, last = [None], 0
            for v in index.places():
                if (v >> 16) - last >= self.split:
                    cuts.append(v)
                    last = v >> 16
            return [Piece(path, [c]) for c in zip(cuts, [*cuts[1:], None], strict=True)]
        if not blocks:  # plain gzip members do not tell where the next one begins
            return [Piece(path, [(None, None)])]
        return [Piece(path, [], (a, min(a + self.split, size))) for a in range(0, size, self.split)]

    def read(self, partition):
        if not partition.path:
            return
        with _open(partition.path) as file:
            if self.complete and (file.size() < len(LAST_BLOCK) or file.read_at(len(LAST_BLOCK), file.size() - len(LAST_BLOCK)) != LAST_BLOCK):
                raise ValueError(f"{partition.path}: the file is cut off")
            stream = Blocks(file, 0, None if not partition.bytes and partition.chunks[0][0] is None else 0)
            contigs = parse_header(stream)[1]
            names, lengths = [n for n, _ in contigs], [n for _, n in contigs]
            first, chunks = None, partition.chunks
            if partition.bytes or chunks[0][0] is None:
                first = stream.begins()
            if partition.bytes:
                a, b = partition.bytes
                first = None if first is None or first >> 16 >= b else first if first >> 16 >= a else bam.first_record(file, a, b, lengths)
                chunks = [] if first is None else [(first, b << 16)]
            keep = self._kept(names, lengths)
            rows = []
            for a, b in chunks:
                for d in self._records(stream if a is None else Blocks(file, a, b), b, partition.path):
                    if keep(d):
                        rows.append(parse_record(d, names))
                        if len(rows) == ROWS:
                            yield _batch(rows)
                            rows = []
            if rows:
                yield _batch(rows)

    @staticmethod
    def _records(stream, end, path):
        while (at := stream.begins()) is not None and (end is None or at < end):
            size = struct.unpack("<i", stream.read(4))[0]
            d = stream.read(size)
            if len(d) < size:
                raise ValueError(f"{path}: a record is cut off")
            yield d

    def _kept(self, names, lengths):
        """A test of packed records."""
        wanted, tests = self._wanted(names, lengths), self.tests
        if wanted is None and not tests:
            return lambda d: True
        by: dict[int, tuple[list[int], list[int]]] = {}
        for ref, a, b in wanted or ():
            begins, ends = by.setdefault(ref, ([], []))
            begins.append(a)
            ends.append(max(b, ends[-1] if ends else 0))

        def keep(d):
            if tests:
                pos, mapq, flag = struct.unpack_from("<i", d, 4)[0], d[9], struct.unpack_from("<H", d, 14)[0]
                values = {"pos": pos, "mapq": mapq, "flag": flag}
                if not all(_TESTS[how](values[c], v) for c, how, v in tests):
                    return False
            if wanted is None:
                return True
            ref, a, b = bam.span_of(d)
            begins, ends = by.get(ref, ((), ()))
            k = bisect_right(begins, b - 1)  # regions that begin before the record ends
            return k > 0 and ends[k - 1] > a

        return keep


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    text = pa.map_(pa.string(), pa.string())
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int32()), text, text, pa.string(), pa.int64(), pa.int32()]
    names = [c.split()[0] for c in READS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _paths(options) -> list[str]:
    paths = [p for p in (options.get("paths") or options.get("path") or "").split(",") if p]
    if not paths:
        raise ValueError("a BAM source needs a path")
    return [check_path(p) for p in paths]


class BamWriter(PartsWriter):
    """A folder of complete BAM files, each with its index."""

    suffix = ".bam"

    def __init__(self, path: str, schema, header: str, overwrite: bool):
        self.header = header
        self.columns = schema.fieldNames()
        self.scores = [f.name for f in schema.fields if len(f.name) == 2 and f.dataType.simpleString() == "float"]
        missing = {c.split()[0] for c in READS.split(", ")} - set(self.columns)
        if missing:
            raise ValueError(f"a BAM file needs the columns {', '.join(sorted(missing))}")
        self.contigs = header_contigs(header)
        super().__init__(path, overwrite)

    def write(self, iterator):
        out = index = None
        places = {n: k for k, (n, _) in enumerate(self.contigs)}
        reads = [c.split()[0] for c in READS.split(", ")]
        for batch in iterator:
            if out is None and batch.num_rows:
                fs, name, place = self.part()
                file = fs.open_output_stream(place, compression=None)
                out, index = bam.BlockWriter(file), bam.Index()
                out.write(bam.pack_header(self.header, self.contigs))
                out.flush()
            columns = [batch.column(self.columns.index(c)).to_pylist() for c in reads]
            scores = [batch.column(self.columns.index(c)).to_pylist() for c in self.scores]
            for k, row in enumerate(zip(*columns, strict=True)):
                at = out.tell()
                raw = bam.pack_record(places, *row, [(n, v[k]) for n, v in zip(self.scores, scores, strict=True)])
                out.write(raw)
                if row[2] is not None:
                    index.add(*bam.span_of(raw[4:]), at, out.tell())
        if out is None:
            return Part([])
        out.finish()
        file.close()
        with fs.open_output_stream(place + ".bai", compression=None) as f:
            f.write(index.pack(len(self.contigs)))
        return Part([name, name + ".bai"])

    def empty(self, file):
        out = bam.BlockWriter(file)
        out.write(bam.pack_header(self.header, self.contigs))
        out.finish()


def header_contigs(header: str) -> list[tuple[str, int]]:
    """(name, length) of the contigs of a header's text, in order."""
    fields = [dict(f.split(":", 1) for f in line.split("\t")[1:] if ":" in f) for line in header.splitlines() if line.startswith("@SQ")]
    return [(f["SN"], int(f["LN"])) for f in fields]


class BamSource(DataSource):
    """spark.read.format("bam").load(path), or .option("paths", "a,b"); a path is a file, or a folder that was written.
    Options split (bytes), complete (false: take a file that has no last block) and regions (JSON, a list of [contig,
    begin, end]).

    df.write.format("bam").option("header", text).save(path) takes READS rows in the order that they are to have, further
    columns of 32-bit floats with names of two letters are tags. ``sinks.write_bam`` sorts and writes."""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return READS

    def reader(self, schema):
        complete = str(self.options.get("complete", "true")).lower() != "false"
        regions = self.options.get("regions")
        return BamReader(_paths(self.options), int(self.options.get("split", SPLIT_BYTES)), complete, None if regions is None else [tuple(r) for r in json.loads(regions)])

    def writer(self, schema, overwrite):
        return BamWriter(self.options["path"], schema, self.options.get("header", ""), overwrite)


class BamHeaderReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [InputPartition(found[0]) for p in self.paths if (found := files([p], ".bam"))]

    def read(self, partition):
        with _open(partition.value) as file:
            text, contigs = parse_header(Blocks(file))
        lines = text.splitlines()
        if not any(x.startswith("@SQ") for x in lines):
            lines += [f"@SQ\tSN:{n}\tLN:{size}" for n, size in contigs]
        yield from ((x,) for x in lines)


class BamHeaderSource(BamSource):
    """The header's lines, as in SAM."""

    @classmethod
    def name(cls):
        return "bam_header"

    def schema(self):
        return "value string"

    def reader(self, schema):
        return BamHeaderReader(_paths(self.options))


def register(spark: SparkSession) -> None:
    # the BAM reader takes filters, which Spark has to be told to give
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamSource)
    spark.dataSource.register(BamHeaderSource)
    spark.dataSource.register(FastaSource)


def read_alignments(spark: SparkSession, path: str, regions: list | None = None) -> DataFrame:
    """READS rows. regions (contig, begin, end): those that a later filter can use at most; a BAM file with an index is then
    read there only."""
    check_path(path)
    if path.endswith(".bam"):
        register(spark)
        source = spark.read.format("bam")
        return (source if regions is None else source.option("regions", json.dumps(regions))).load(path)
    return read_sam(spark, path)


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """The header's lines, column value, in order where the file is one. Of a folder of BAM files, the first one's."""
    if path.endswith(".bam"):
        register(spark)
        return spark.read.format("bam_header").load(check_path(path))
    return spark.read.text(check_path(path)).where("startswith(value, '@')")


def contigs(header: DataFrame) -> DataFrame:
    """rname, length of the header's contigs."""
    part = lambda k: F.regexp_extract("value", rf"\t{k}:([^\t]*)", 1)
    return header.where("startswith(value, '@SQ')").select(part("SN").alias("rname"), part("LN").cast("long").alias("length"))
