"""The BAM format: blocks, records and indexes, read and written as bytes. The Spark side of it is in ``alignments``."""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_right

from ..functions.bases import CIGAR_OPS, NIBBLES
from ..schema import NO_QUALITY

_TAG = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
#: The empty block that ends a complete file, and the beginning of every block; fixed values of the format.
LAST_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK_HEAD = bytes.fromhex("1f8b08040000000000ff060042430200")
#: Uncompressed bytes of a block that is written; the format has 64 kB at most.
BLOCK_BYTES = 0xFF00
#: Fixed values of the index: bits of a place inside a bin and the number of the first bin, by level, finest first; bits of a window of
#: the linear index; the bin that holds counts.
LEVELS, WINDOW_BITS, COUNTS_BIN = ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1), (29, 0)), 14, 37450
#: Records in a row that have to be plausible where a record is looked for without an index.
CHAIN = 8
QUERY_OPS, REFERENCE_OPS = frozenset("MIS=X"), frozenset("MDN=X")


def open_file(path: str):
    from pyarrow.fs import FileSystem, LocalFileSystem

    if "://" in path:
        fs, path = FileSystem.from_uri(path)
        return fs.open_input_file(path)
    return LocalFileSystem().open_input_file(path)


# reading

def _tags(data: bytes) -> tuple[dict[str, str], dict[str, str]]:
    """Values and types as SAM writes them."""
    out, types, at = {}, {}, 0
    while at < len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(0, at)
            out[name], at = data[at:end].decode(), end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            out[name] = ",".join([sub, *map(str, struct.unpack_from(f"<{n}{_TAG[sub]}", data, at + 5))])
            at += 5 + n * struct.calcsize(_TAG[sub])
        else:
            v = struct.unpack_from(f"<{_TAG[kind]}", data, at)[0]
            out[name], at = v.decode() if kind == "A" else str(v), at + struct.calcsize(_TAG[kind])
        types[name] = "i" if kind in "cCsSiI" else kind
    return out, types


class Blocks:
    """The uncompressed bytes of a file of gzip members, from a virtual offset (member's place << 16 | place in it) on.
    end: the virtual offset up to which they are wanted; not much more of the file is read."""

    def __init__(self, file, voffset: int = 0, end: int | None = None):
        self.file, self.size = file, file.size()
        self.reach = self.size if end is None else (end >> 16) + (1 << 16 if end & 0xFFFF else 0)
        self.raw, self.next = b"", voffset >> 16  # compressed bytes at hand, where the bytes after them are
        self.data, self.at, self.block, self.gone, self.inflate = b"", 0, voffset >> 16, 0, None
        self.read(voffset & 0xFFFF)

    def tell(self) -> int:
        return self.block << 16 | (self.gone + self.at)

    def _more(self) -> bool:
        """The next bytes; False at the end of the file."""
        while True:
            if not self.raw:
                if self.next >= self.size:
                    return False
                self.raw = self.file.read_at(min(1 << 18, max(1 << 14, self.reach - self.next), self.size - self.next), self.next)
                self.next += len(self.raw)
            if self.inflate is None:
                self.inflate, self.block, self.gone, self.data = zlib.decompressobj(31), self.next - len(self.raw), 0, b""
            self.gone += len(self.data)
            self.data, self.at = self.inflate.decompress(self.raw, 1 << 20), 0
            self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.inflate = None
            if self.data:
                return True

    def read(self, n: int) -> bytes:
        out = []
        while n > 0:
            if self.at == len(self.data) and not self._more():
                break
            part = self.data[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            out.append(part)
        return b"".join(out)

    def begins(self) -> int | None:
        """The virtual offset of the next byte; None at the end."""
        return self.tell() if self.at < len(self.data) or self._more() else None


def parse_header(stream) -> tuple[str, list[tuple[str, int]]]:
    """Header text and (name, length) of the contigs of an uncompressed BAM stream."""
    if stream.read(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    number = lambda: struct.unpack("<i", stream.read(4))[0]
    text = stream.read(number()).rstrip(b"\0").decode()
    return text, [(stream.read(number())[:-1].decode(), number()) for _ in range(number())]


def parse_record(d: bytes, names: list[str]) -> tuple:
    """The values of READS."""
    ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, next_ref, next_pos, tlen = struct.unpack_from("<iiBBHHHiiii", d)
    at = 32
    qname = d[at : at + l_name - 1].decode()
    at += l_name
    ops = struct.unpack_from(f"<{n_cigar}I", d, at)
    at += 4 * n_cigar
    packed = d[at : at + (l_seq + 1) // 2]
    at += (l_seq + 1) // 2
    seq = "".join([_PAIRS[b] for b in packed])[:l_seq]
    tags, types = _tags(d[at + l_seq :])
    cigar = "".join([f"{o >> 4}{CIGAR_OPS[o & 15]}" for o in ops]) or None
    if n_cigar == 2 and "CG" in tags and ops[0] == l_seq << 4 | 4:  # of more operations than the field can count
        cigar = "".join(f"{int(o) >> 4}{CIGAR_OPS[int(o) & 15]}" for o in tags.pop("CG").split(",")[1:])
        del types["CG"]
    name = lambda k: names[k] if k >= 0 else None
    return (
        qname, flag, name(ref), pos, mapq, cigar, seq or None, list(d[at : at + l_seq]), list(tags.items()), list(types.items()), name(next_ref), next_pos, tlen,
    )


_PAIRS = [NIBBLES[b >> 4] + NIBBLES[b & 15] for b in range(256)]


def span_of(d: bytes) -> tuple[int, int, int]:
    """Contig, begin and end on the reference of a record; a record without operations is one base long."""
    ref, pos, l_name, _, _, n_cigar = struct.unpack_from("<iiBBHH", d)
    ops = struct.unpack_from(f"<{n_cigar}I", d, 32 + l_name)
    return ref, pos, pos + max(1, sum(o >> 4 for o in ops if CIGAR_OPS[o & 15] in REFERENCE_OPS))


# finding records without an index


def block_size(head: bytes) -> int:
    """Bytes of the block that begins with ``head``; 0 if none does."""
    if head[:4] != BLOCK_HEAD[:4] or len(head) < 18 or head[12:16] != BLOCK_HEAD[12:16]:
        return 0
    return struct.unpack_from("<H", head, 16)[0] + 1


def next_block(file, begin: int) -> int | None:
    """Where the first block at or after ``begin`` begins: its size leads to another block, or to the file's end, twice."""
    size = file.size()

    def leads(at: int, more: int) -> bool:
        if at == size:
            return True
        n = block_size(file.read_at(min(18, size - at), at)) if at < size else 0
        return n > 0 and (more == 0 or leads(at + n, more - 1))

    while begin < size:
        raw = file.read_at(min(1 << 17, size - begin), begin)
        at = raw.find(BLOCK_HEAD[:4])
        while at >= 0:
            if leads(begin + at, 2):
                return begin + at
            at = raw.find(BLOCK_HEAD[:4], at + 1)
        begin += max(1, len(raw) - 3)
    return None


class _Unpacked:
    """The uncompressed bytes from a block on, as far as they have been asked for, and which block each comes from."""

    def __init__(self, file, at: int):
        self.file, self.size, self.next = file, file.size(), at
        self.data, self.begins, self.blocks = bytearray(), [], []

    def has(self, n: int) -> bool:
        while len(self.data) < n and self.next < self.size:
            size = block_size(self.file.read_at(min(18, self.size - self.next), self.next))
            if not size:
                raise ValueError(f"no block at {self.next}")
            part = zlib.decompress(self.file.read_at(size, self.next), 31)
            if part:
                self.begins.append(len(self.data))
                self.blocks.append(self.next)
                self.data += part
            self.next += size
        return len(self.data) >= n

    def voffset(self, at: int) -> int:
        k = bisect_right(self.begins, at) - 1
        return self.blocks[k] << 16 | (at - self.begins[k])


def _plausible(u: _Unpacked, at: int, lengths: list[int]) -> int | None:
    """Where the record after the one at ``at`` would begin, if there can be a record."""
    if not u.has(at + 36):
        return None
    size, ref, pos, l_name, _, _, n_cigar, _, l_seq, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", u.data, at)
    for r, p in ((ref, pos), (next_ref, next_pos)):
        if not -1 <= r < len(lengths) or not -1 <= p <= (lengths[r] if r >= 0 else 1 << 31):
            return None
    fixed = 32 + l_name + 4 * n_cigar
    if l_name < 1 or l_seq < 0 or size < fixed + (l_seq + 1) // 2 + l_seq or not u.has(at + 4 + fixed):
        return None
    name = u.data[at + 36 : at + 36 + l_name]
    if name[-1] != 0 or not all(33 <= c <= 126 for c in name[:-1]):
        return None
    ops = struct.unpack_from(f"<{n_cigar}I", u.data, at + 36 + l_name)
    if any(o & 15 > 8 for o in ops) or (ops and l_seq and sum(o >> 4 for o in ops if CIGAR_OPS[o & 15] in QUERY_OPS) != l_seq):
        return None
    return at + 4 + size


def first_record(file, begin: int, end: int, lengths: list[int]) -> int | None:
    """The virtual offset of the first record that begins in a block at ``begin`` or later, and before ``end``.

    Every place is tried in turn: a record begins there if it and those that follow it look like records, CHAIN of them
    or as many as the file still has.
    """
    block = next_block(file, begin)
    if block is None or block >= end:
        return None
    u, at = _Unpacked(file, block), 0
    while u.has(at + 1):
        where = u.voffset(at)
        if where >> 16 >= end:
            return None
        follow, n = at, 0
        while follow is not None and n < CHAIN:
            if n and not u.has(follow + 1):
                n = CHAIN  # the file ends with a record
                break
            follow, n = _plausible(u, follow, lengths), n + 1
        if follow is not None and n == CHAIN:
            return where
        at += 1
    return None


# indexes


def bin_of(begin: int, end: int) -> int:
    """The smallest bin that holds the places from begin to before end."""
    for bits, first in LEVELS:
        if begin >> bits == (end - 1) >> bits:
            return first + (begin >> bits)
    return 0


def bins_over(begin: int, end: int) -> list[int]:
    """All bins that may hold alignments over some place from begin to before end."""
    return [first + k for bits, first in LEVELS for k in range(begin >> bits, ((end - 1) >> bits) + 1)]


class Index:
    """By contig: the chunks (pairs of virtual offsets) of each bin, and the least offset of each window."""

    def __init__(self):
        self.bins: list[dict[int, list[tuple[int, int]]]] = []
        self.windows: list[list[int]] = []

    @classmethod
    def parse(cls, data: bytes) -> Index:
        if data[:4] != b"BAI\x01":
            raise ValueError("not a BAM index")
        out, at = cls(), 8
        for _ in range(struct.unpack_from("<i", data, 4)[0]):
            bins, n_bin = {}, struct.unpack_from("<i", data, at)[0]
            at += 4
            for _ in range(n_bin):
                number, n = struct.unpack_from("<Ii", data, at)
                flat = struct.unpack_from(f"<{2 * n}Q", data, at + 8)
                if number != COUNTS_BIN:
                    bins[number] = list(zip(flat[::2], flat[1::2], strict=True))
                at += 8 + 16 * n
            n = struct.unpack_from("<i", data, at)[0]
            out.bins.append(bins)
            out.windows.append(list(struct.unpack_from(f"<{n}Q", data, at + 4)))
            at += 4 + 8 * n
        return out

    def places(self) -> list[int]:
        """Virtual offsets at which records begin."""
        found = {a for bins in self.bins for chunks in bins.values() for a, _ in chunks}
        return sorted((found | {v for w in self.windows for v in w}) - {0})

    def chunks(self, regions: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
        """Disjoint chunks, in order, that hold all alignments over the regions (contig, begin, end)."""
        found = set()
        for ref, begin, end in regions:
            if ref >= len(self.bins) or begin >= end:
                continue
            w = self.windows[ref]
            least = w[min(begin >> WINDOW_BITS, len(w) - 1)] if w else 0
            bins = self.bins[ref]
            near = bins_over(begin, end) if end - begin < 1 << 20 else [b for b in bins if _overlaps(b, begin, end)]
            found.update((max(a, least), b) for k in near for a, b in bins.get(k, ()) if b > least)
        out: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if out and a >> 16 <= (out[-1][1] >> 16) + (1 << 16):  # no further than a block, which is read anyway
                out[-1] = out[-1][0], max(b, out[-1][1])
            else:
                out.append((a, b))
        return out

    def add(self, ref: int, begin: int, end: int, at: int, after: int) -> None:
        """A record at the virtual offset ``at``; records come in order."""
        while len(self.bins) <= ref:
            self.bins.append({})
            self.windows.append([])
        chunks = self.bins[ref].setdefault(bin_of(begin, end), [])
        if chunks and chunks[-1][1] == at:
            chunks[-1] = chunks[-1][0], after
        else:
            chunks.append((at, after))
        w = self.windows[ref]
        last = (end - 1) >> WINDOW_BITS
        # windows that no record has touched so far get the place of the next one that lies beyond them
        w.extend([at] * (last + 1 - len(w)))

    def pack(self, n_ref: int) -> bytes:
        out = [b"BAI\x01", struct.pack("<i", n_ref)]
        for k in range(n_ref):
            bins, w = (self.bins[k], self.windows[k]) if k < len(self.bins) else ({}, [])
            out.append(struct.pack("<i", len(bins)))
            for number in sorted(bins):
                flat = [v for chunk in bins[number] for v in chunk]
                out.append(struct.pack(f"<Ii{len(flat)}Q", number, len(flat) // 2, *flat))
            out.append(struct.pack(f"<i{len(w)}Q", len(w), *w))
        return b"".join(out)


def _overlaps(number: int, begin: int, end: int) -> bool:
    bits, first = next((bits, first) for bits, first in LEVELS if number >= first)
    a = (number - first) << bits
    return a < end and a + (1 << bits) > begin


# writing


class BlockWriter:
    """Writes bytes as blocks to ``out``."""

    def __init__(self, out, size: int = BLOCK_BYTES):
        self.out, self.size, self.held, self.gone = out, size, bytearray(), 0

    def tell(self) -> int:
        """The virtual offset of the next byte."""
        return self.gone << 16 | len(self.held)

    def write(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= self.size:
            self._block(self.size)

    def _block(self, n: int) -> None:
        part = bytes(self.held[:n])
        del self.held[:n]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        if len(body) + 25 > 0xFFFF:  # cannot be made smaller
            z = zlib.compressobj(0, zlib.DEFLATED, -15)
            body = z.compress(part) + z.flush()
        raw = BLOCK_HEAD + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
        self.out.write(raw)
        self.gone += len(raw)

    def flush(self) -> None:
        if self.held:
            self._block(len(self.held))

    def finish(self) -> None:
        self.flush()
        self.out.write(LAST_BLOCK)


def pack_header(text: str, contigs: list[tuple[str, int]]) -> bytes:
    t = text.encode()
    out = [b"BAM\x01", struct.pack("<i", len(t)), t, struct.pack("<i", len(contigs))]
    for name, length in contigs:
        n = name.encode() + b"\0"
        out += [struct.pack("<i", len(n)), n, struct.pack("<i", length)]
    return b"".join(out)


_HEX = {ord(c): f"{k:x}" for k, c in enumerate(NIBBLES)} | {ord(c.lower()): f"{k:x}" for k, c in enumerate(NIBBLES)}
_OPERATION = re.compile(rf"(\d+)([{CIGAR_OPS}])")
#: Integer types by the smallest and the largest value, the narrowest first.
_WHOLE = (("c", -128, 127), ("C", 0, 255), ("s", -(1 << 15), (1 << 15) - 1), ("S", 0, (1 << 16) - 1), ("i", -(1 << 31), (1 << 31) - 1), ("I", 0, (1 << 32) - 1))


def pack_tag(name: str, kind: str, value) -> bytes:
    head = name.encode()
    if kind == "A":
        return head + b"A" + value.encode()[:1]
    if kind == "i":
        v = int(value)
        kind = next(k for k, low, high in _WHOLE if low <= v <= high)
        return head + kind.encode() + struct.pack(f"<{_TAG[kind]}", v)
    if kind == "f":
        return head + b"f" + struct.pack("<f", float(value))
    if kind == "B":
        sub, *items = value.split(",")
        number = float if sub == "f" else int
        return head + b"B" + sub.encode() + struct.pack(f"<i{len(items)}{_TAG[sub]}", len(items), *map(number, items))
    return head + (b"H" if kind == "H" else b"Z") + value.encode() + b"\0"


def pack_record(places: dict[str, int], qname, flag, rname, pos, mapq, cigar, seq, qual, tags, types, rnext=None, pnext=-1, tlen=0, scores=()) -> bytes:
    """A record, with its size before it. tags, types: pairs; scores: further tags of 32-bit floats (name, value)."""
    pos, pnext = -1 if pos is None else pos, -1 if pnext is None else pnext
    ops = [int(n) << 4 | CIGAR_OPS.index(o) for n, o in _OPERATION.findall(cigar or "")]
    size = sum(o >> 4 for o in ops if CIGAR_OPS[o & 15] in REFERENCE_OPS)
    extra = b""
    seq = seq or ""
    if len(ops) > 0xFFFF:
        extra = b"CGBI" + struct.pack(f"<i{len(ops)}I", len(ops), *ops)
        ops = [len(seq) << 4 | 4, size << 4 | 3]
    kinds, own = dict(types or ()), {n for n, _ in scores}
    extra = b"".join([pack_tag(k, kinds.get(k, "Z"), v) for k, v in tags or () if k not in own] + [extra] + [pack_tag(n, "f", v) for n, v in scores if v is not None])
    packed = bytes.fromhex(seq.translate(_HEX) + "0" * (len(seq) % 2))
    name = (qname or "*").encode() + b"\0"
    body = struct.pack(
        "<iiBBHHHiiii", -1 if rname is None else places[rname], pos, len(name), 255 if mapq is None else mapq, bin_of(pos, pos + max(1, size)), len(ops), flag, len(seq),
        -1 if rnext is None else places[rnext], pnext, tlen or 0,
    ) + name + struct.pack(f"<{len(ops)}I", *ops) + packed + (bytes(qual) if qual else bytes([NO_QUALITY]) * len(seq)) + extra
    return struct.pack("<i", len(body)) + body
