"""WARC archives: write, index, and read selected records by coalesced byte ranges.

Index first: while a task writes its archive it notes offset, length, URL and digest of every record. The index is a
small table; a reader selects from it, sorts the selection by archive and offset, joins neighbouring byte ranges to one
read and unpacks the records from it. Archives are gzip files with one member a record, so any range of members reads
alone. They lie in the cluster's shared folder under names that no other attempt of a task uses; only the archives
that the finished attempts noted are ever read, so lost executors leave at most files that nobody looks at.

Identical payloads are stored once: of the records of one payload digest, that with the largest page_id is the
``response``, the others are ``revisit`` records that refer to it. Payloads under ``min_bytes`` are always stored.

Defined results: a null payload is an empty one; a null url is written as an empty one; repeated rows each get a record,
and all rows with the largest page_id of a digest are responses; a null page_id is never preferred to another, and a
digest that has only null ones is stored each time; an empty table gives an empty index; other columns are ignored.
Memory follows one read (``READ_BYTES``) or the largest record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: An archive is closed when it has this many bytes.
ARCHIVE_BYTES = 64 << 20
#: Ranges this near to each other are one read, up to READ_BYTES.
GAP_BYTES, READ_BYTES = 64 << 10, 4 << 20
LEVEL = 4

INDEX = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("archive", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
    ]
)
RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
    ]
)


def _filesystem(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    target = quote(url, safe="%/:?#[]@!$&'()*+,;=~-._")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {target}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
        payload = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(lines).encode() + payload + b"\r\n\r\n"


def _parse(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    h = dict(x.split(": ", 1) for x in (y if ": " in y else y.rstrip(":") + ": " for y in lines[1:]))
    number = lambda s: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", s)) else None
    payload = rest[: int(h["Content-Length"])]
    if rest[len(payload) :] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut off")
    stated = h["WARC-Payload-Digest"].removeprefix("sha1:")
    whole = h["WARC-Type"] == "response"
    if whole and _digest(payload) != stated:
        raise ValueError("a payload does not have its digest")
    return {
        "page_id": number(h["WARC-Record-ID"]),
        "url": h["WARC-Target-URI"],
        "payload": payload if whole else None,
        "payload_bytes": len(payload) if whole else int(h["X-Payload-Length"]),
        "payload_digest": stated,
        "record_type": h["WARC-Type"],
        "refers_to": number(h.get("WARC-Refers-To", "")),
    }


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write page_id, url, html of ``pages`` as archives in ``folder``; the index, itself a written table."""
    spark = pages.sparkSession
    common.tune(spark)
    rows = pages.select(
        "page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    ).withColumn("sha", F.sha1("payload"))
    # the largest id of each digest; Spark splits a digest with very many pages in the join
    last = rows.where(F.length("payload") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("kept_id"))
    rows = rows.join(last, "sha", "left").select(
        "page_id",
        "url",
        "payload",
        F.when(F.coalesce(F.col("page_id") != F.col("kept_id"), F.col("kept_id").isNotNull()), F.col("kept_id")).alias("refers_to"),
    )

    def run(batches):
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        out = name = None
        noted, at = [], 0

        def close():
            out.close()
            return pa.RecordBatch.from_pylist(noted, schema=schema)

        schema = pa.schema([(f.name, pa.int64() if f.dataType == T.LongType() else pa.string()) for f in INDEX.fields])
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(i) for i in range(4)), strict=True):
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                page_id, url, payload, refers_to = page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py()
                digest = _digest(payload)
                z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = z.compress(_record(page_id, url, payload, digest, refers_to)) + z.flush()
                out.write(data)
                kind = "response" if refers_to is None else "revisit"
                noted.append(dict(zip(INDEX.names, (page_id, url, name, at, len(data), digest, kind), strict=True)))
                at += len(data)
                if at >= ARCHIVE_BYTES:
                    yield close()
                    out, noted = None, []
        if out is not None:
            yield close()

    return common.written(rows.mapInArrow(run, INDEX), "warc-index")


def read_warc(selected: DataFrame, folder: str) -> DataFrame:
    """The records of ``selected`` rows of an index, parsed and checked."""
    n = int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = (
        selected.select("archive", "offset", "length", F.floor(F.col("offset") / ARCHIVE_BYTES * 16).alias("part"))
        .repartition(n, "archive", "part")
        .sortWithinPartitions("archive", "offset")
    )

    def reads(batches):
        """Runs of neighbouring ranges of one archive."""
        run, archive, end = [], None, 0
        for batch in batches:
            for name, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if run and (name != archive or offset - end > GAP_BYTES or offset + length - run[0][0] > READ_BYTES):
                    yield archive, run
                    run = []
                run.append((offset, length))
                archive, end = name, offset + length
        if run:
            yield archive, run

    def run(batches):
        fs, root = _filesystem(folder)
        schema = pa.schema(
            [(f.name, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.dataType.typeName()]) for f in RECORD.fields]
        )
        opened = source = None
        for archive, spans in reads(batches):
            if archive != opened:
                opened, source = archive, fs.open_input_file(f"{root}/{archive}")
            begin = spans[0][0]
            data = source.read_at(spans[-1][0] + spans[-1][1] - begin, begin)
            yield pa.RecordBatch.from_pylist(
                [_parse(zlib.decompress(data[o - begin : o - begin + n], 31)) for o, n in spans], schema=schema
            )

    return ranges.select("archive", "offset", "length").mapInArrow(run, RECORD)


def op1_warc(spark, sf_dir):
    folder = common.fresh(spark, "warc")
    index = write_warc(common.table(spark, sf_dir, "pages"), folder)
    return read_warc(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages)
  , last AS (SELECT hex, max(page_id) AS kept_id FROM p GROUP BY hex)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(hex, 1 + 10 * CAST(i // 8 AS INTEGER), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = kept_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> kept_id THEN kept_id END AS refers_to, url
FROM p JOIN last USING (hex)
"""
