"""Rebuilding the reference under a read from CIGAR and MD, or from the reference itself.

The result is ALIGNED: base codes of reference and read in the order of the forward reference, one for each read base.
Inserted and soft-clipped bases have no reference (code 4). A CIGAR string is a map of intervals of the read to intervals
of the reference: M, = and X run along both, I and S along the read, D and N along the reference, H and P along neither.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LETTER = np.full(256, 4, np.int8)
for _i, _c in enumerate(b"ACGT"):
    _LETTER[_c] = _LETTER[_c + 32] = _i
_CARET, _END = ord("^"), ord("\n")
_letters = lambda ops: np.frombuffer(ops, np.uint8)
#: Operations by what they run along: the read, the reference, both.
READ_OPS, REFERENCE_OPS, BOTH_OPS, ALL_OPS = map(_letters, (b"MIS=X", b"MDN=X", b"M=X", b"MIDNSHP=X"))


def _lines(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings, each with a line end after it, and the string that each byte belongs to."""
    data = np.frombuffer(("\n".join(strings) + "\n").encode(), np.uint8)
    return data, np.repeat(np.arange(len(strings)), np.diff(np.concatenate([[-1], np.flatnonzero(data == _END)])))


def codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Base codes of all strings end to end, and the strings' lengths."""
    data = np.frombuffer("".join(strings).encode(), np.uint8)
    return _LETTER[data], np.fromiter(map(len, strings), np.int64, len(strings))


def _numbers(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The number whose digits end just before each place of ``at`` (-1: none)."""
    digit = (data >= 48) & (data <= 57)
    start = np.maximum.accumulate(np.where(digit, -1, np.arange(len(data))))  # of the last byte that is no digit
    before = np.concatenate([[-1], start[:-1]])[at]
    size = at - 1 - before
    out = np.where(size > 0, 0, -1)
    for k in range(int(size.max(initial=0))):
        d = data[np.maximum(at - 1 - k, 0)].astype(np.int64) - 48
        out += np.where(k < size, d * 10 ** min(k, 18), 0)
    return out


def _per_row(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, weights=value, minlength=n).astype(np.int64)


def _before(value: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Sum of the values before each one in its row; rows stand together."""
    total = np.cumsum(value) - value
    first = np.searchsorted(row, row)
    return total - total[first] if len(row) else total


def _complain(bad: np.ndarray, what: str, cigars: list[str]) -> None:
    if bad.any():
        raise ValueError(f"{what}: CIGAR {cigars[int(np.flatnonzero(bad)[0])]!r}")


def cigar_runs(cigars: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(read, operation letter, length) of every operation of the CIGAR strings."""
    data, row = _lines(cigars)
    at = np.flatnonzero(((data < 48) | (data > 57)) & (data != _END))
    n = _numbers(data, at)
    bad = np.zeros(len(cigars), bool)
    bad[row[at[(n < 0) | ~np.isin(data[at], ALL_OPS)]]] = True
    end = np.flatnonzero(data == _END)
    bad |= (data[np.maximum(end - 1, 0)] == _END) | ((data[np.maximum(end - 1, 0)] >= 48) & (data[np.maximum(end - 1, 0)] <= 57)) | (end == 0)
    _complain(bad, "not a CIGAR string", cigars)
    return row[at], data[at], n


def _laid_out(cigars: list[str], sizes: np.ndarray):
    """(read, operation, length, whether it runs along the read) of every operation; lengths have to fit the reads'."""
    row, op, n = cigar_runs(cigars)
    own = np.isin(op, READ_OPS)
    _complain(_per_row(row[own], n[own], len(cigars)) != sizes, "CIGAR and sequence differ in length", cigars)
    return row, op, n, own


def _mapped(row, op, n, sizes, under):
    """Of the bases that run along both: where they are among all reads' bases, their places among the bases of the
    operations ``under``, and their reads."""
    both = np.isin(op, BOTH_OPS)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    at = np.repeat((starts[row] + _before(np.where(np.isin(op, READ_OPS), n, 0), row))[both], n[both])
    place = np.repeat(_before(n * under, row)[both], n[both])
    step = np.arange(len(at)) - np.repeat(np.cumsum(n[both]) - n[both], n[both])
    return at + step, place + step, np.repeat(row[both], n[both])


def places_under(cigars: list[str], sizes: np.ndarray) -> np.ndarray:
    """Of every read base, end to end: how far along the reference it lies from its alignment's position on; -1 where it
    has no reference."""
    row, op, n, _ = _laid_out(cigars, sizes)
    out = np.full(int(sizes.sum()), -1, np.int64)
    at, place, _ = _mapped(row, op, n, sizes, np.isin(op, REFERENCE_OPS))
    out[at] = place
    return out


def reference_under(source: str, cigars: list[str], other: list[str], seqs: list[str], compat: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the reference under every read base and of the reads, end to end, and the reads' lengths.

    source: what ``other`` has. "md": MD strings; "bases": the reference from each alignment's position on, which may be
    cut at its end. compat (MD only): after a leading soft clip nothing has a reference.
    """
    read, sizes = codes(seqs)
    row, op, n, own = _laid_out(cigars, sizes)
    is_m = np.isin(op, BOTH_OPS)
    out = np.full(len(read), 4, np.int8)
    # the bases that run along both; an MD string leaves out what the read skips
    at, place, of = _mapped(row, op, n, sizes, is_m if source == "md" else np.isin(op, REFERENCE_OPS))
    if source == "md":
        spots, letters, totals = md_changes(other)
        _complain(totals != _per_row(row[is_m], n[is_m], len(seqs)), "MD and CIGAR differ in length", cigars)
        out[at] = read[at]
        first = np.searchsorted(of, np.arange(len(seqs)))
        changed, where = spots
        out[at[first[changed] + where]] = letters
        if compat:
            clipped = np.zeros(len(seqs), bool)
            lead = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
            clipped[row[lead & (op == ord("S"))]] = True
            out[np.repeat(clipped, sizes)] = 4
    else:
        ref, ref_sizes = codes(other)
        there = place < ref_sizes[of]
        out[at[there]] = ref[(np.cumsum(ref_sizes) - ref_sizes)[of[there]] + place[there]]
    return out, read, sizes


def md_changes(mds: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """((read, place among the aligned bases), code) of every base that the MD strings name, and how many aligned bases
    each string tells of. Deleted bases are neither."""
    data, row = _lines(mds)
    digit = (data >= 48) & (data <= 57)
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    # letters up to the next digit belong to the caret before them
    other = np.flatnonzero(digit | (data == _END) | (data == _CARET))
    last = other[np.maximum(np.searchsorted(other, np.arange(len(data)), "right") - 1, 0)] if len(other) else np.zeros(len(data), int)
    named = letter & ~((data[last] == _CARET) & (last < np.arange(len(data))))
    ends = np.flatnonzero(digit & ~np.concatenate([digit[1:], [False]])) + 1
    told = np.zeros(len(data), np.int64)  # aligned bases that end before a place
    told[ends - 1] = _numbers(data, ends)
    told += named
    places = _before(told, row)
    at = np.flatnonzero(named)
    return (row[at], places[at]), _LETTER[data[at]], _per_row(row, told, len(mds))


def reference_of_md(cigar: str, md: str, seq: str, compat: bool = False) -> list[int]:
    """Reference code under each base of one read."""
    return reference_under("md", [cigar], [md], [seq], compat)[0].tolist()


def reference_of_bases(cigar: str, bases: str, seq: str) -> list[int]:
    """From the reference ``bases`` that begin at the alignment's position."""
    return reference_under("bases", [cigar], [bases], [seq])[0].tolist()


def span(cigar) -> F.Column:
    """Reference bases that an alignment covers."""
    from ..functions.bases import cigar_ops

    return F.aggregate(cigar_ops(cigar), F.lit(0), lambda a, x: a + F.when(x["op"].isin("M", "D", "N", "=", "X"), x["len"]).otherwise(0))


def aligned(reads: DataFrame, source: str = "md", compat: bool = False, places: bool = False) -> DataFrame:
    """ALIGNED rows of reads with read_id, flag, cigar, seq, qual and ``md`` or ``bases``; all other columns, cigar and seq
    too, are kept. Whole Arrow batches are rebuilt at once. places: also, from pos, the place on the reference of each
    base, null where it has none."""
    keep = [f for f in reads.schema.fields if f.name not in ("qual", "md", "bases", "length", "ref", "read", *(["places"] if places else []))]
    names = [f.name for f in keep]
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([*keep, T.StructField("length", T.IntegerType()), *(T.StructField(c, ints) for c in ("ref", "read", "qual"))])
    if places:
        schema.add("places", T.ArrayType(T.LongType()))

    def run(batches):
        for batch in batches:
            cigars, other, seqs = (batch.column(c).to_pylist() for c in ("cigar", source, "seq"))
            if any(x is None for x in other):
                raise ValueError(f"a read has no {source}")
            if any(x is None for x in (*cigars, *seqs)):
                raise ValueError("a read has no CIGAR or no sequence")
            ref, read, sizes = reference_under(source, cigars, other, seqs, compat)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (ref, read)]
            lists.append(batch.column("qual").cast(pa.list_(pa.int32())))
            if places:
                off = places_under(cigars, sizes)
                on = np.repeat(batch.column("pos").to_numpy(zero_copy_only=False).astype(np.int64), sizes) + off
                lists.append(pa.ListArray.from_arrays(offsets, pa.array(on, mask=off < 0)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sizes.astype(np.int32)), *lists], schema.fieldNames())

    return reads.mapInArrow(run, schema)
