"""SentencePiece encoding and decoding as a max-plus parallel scan.

The vocabulary is a public BPE model with byte fallback. A sequence of pieces is the BPE encoding of its text exactly if
every piece encodes to itself and every two neighbours encode to themselves: then no merge across a border ever comes
first. So a text is a lattice whose arcs are pieces; an arc weighs its piece's score if it may follow the piece before it
and minus infinity otherwise, and the encoding is the one path of finite weight.

* Texts of up to ``CHUNK_CHARS`` are cut at borders that no piece crosses (before a space, around a character that no
  longer piece contains); the units in between are solved once and kept in a bounded cache, short ones by merging, long
  ones as the lattice's path.
* Longer texts are cut at fixed places into chunks of CHUNK_CHARS, which Spark spreads over tasks. A border has a state:
  the piece that reaches or crosses it. Every chunk gives a max-plus matrix from entry to exit states, FAN neighbours at a
  time are multiplied to one, round after round (up), then the states at the borders are traced back from the whole
  text's to the chunks', round after round (down), and every chunk is solved by itself between its two states.
  A chunk that has a border which no piece crosses has a matrix of rank one in max-plus: a vector of its entries and one
  of its exits. So have products with such a factor, and the tables of matrices stay small.

Normalisation is the model's own: identity, one space put in front, spaces written as U+2581. Decoding undoes this, so
the round trip is exact for every text without U+2581, which decodes to a space.

Defined results: a null or empty text has no pieces and decodes to ''; repeated rows are encoded each; ids pass through,
null ones too; an empty table gives no rows; other columns are kept, but ``n_tokens`` and ``token_ids`` are replaced, and
names that begin with ``__pf_`` are not for users.
"""

from __future__ import annotations

import json
import re
import string
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK_CHARS = 32_768
#: Matrices that are multiplied in one step of the scan.
FAN = 16
CACHED_UNITS, CACHED_HEADS, CACHED_PAIRS, HEAD = 200_000, 80_000, 250_000, 6
#: Units up to so many characters are merged directly.
SHORT_UNIT = 48
SPACE = "▁"
#: Numbers of pieces: ids, then code points of characters without a piece, and the beginning.
BITS, NO_PIECE = 22, 1 << 20
NO_PAIR = (1 << 40, -1)
BEGIN = (1 << BITS) - 1
CLEAN = ("", 0)  # the state before the first and after the last chunk

RESULT = [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType()))]


class Pairs:
    """The pairs of pieces that merge, as a hash table in numpy, and merging of many words at once."""

    NONE = np.int32(1 << 30)

    def __init__(self, pair: dict[int, tuple[int, int]], chars: dict[str, int]):
        keys = np.fromiter(pair, np.uint64, len(pair))
        self.shift = np.uint64(64 - max(10, (8 * len(pair)).bit_length()))
        size = (1 << (64 - int(self.shift))) + 64
        self.key = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.rank, self.made = np.full(size, self.NONE, np.int32), np.zeros(size, np.int32)
        self.probes = 1
        for k, h, (rank, made) in zip(keys.tolist(), self._hash(keys).tolist(), pair.values(), strict=True):
            at = h
            while self.key[at] != 0xFFFFFFFFFFFFFFFF:
                at += 1
            self.key[at], self.rank[at], self.made[at] = k, rank, made
            self.probes = max(self.probes, at - h + 1)
        self.char = np.arange(0x110000, dtype=np.int32) + NO_PIECE
        for c, number in chars.items():
            self.char[ord(c)] = number

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair; NONE where there is none."""
        keys = (a.astype(np.uint64) << np.uint64(BITS)) | b.astype(np.uint64)
        at = self._hash(keys)
        rank, made = np.full(len(keys), self.NONE, np.int32), np.zeros(len(keys), np.int32)
        for k in range(self.probes):
            hit = np.flatnonzero(self.key[at + k] == keys)
            rank[hit], made[hit] = self.rank[at[hit] + k], self.made[at[hit] + k]
        return rank, made

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of all words end to end, and where each word's end. In each round every word merges its
        best pair, the leftmost of equals."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        piece = self.char[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        word = np.repeat(np.arange(len(words)), size)
        rank, made = np.full(len(piece), self.NONE, np.int32), np.zeros(len(piece), np.int32)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner], made[inner] = self.look_up(piece[inner], piece[inner + 1])
        done = []
        while len(word):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            n = np.diff(np.concatenate([first, [len(word)]]))
            best = np.minimum.reduceat(rank, first)
            live = np.repeat(best < self.NONE, n)
            if not live.all():
                done.append((word[~live], piece[~live]))
                word, piece, rank, made = word[live], piece[live], rank[live], made[live]
                n, best = n[best < self.NONE], best[best < self.NONE]
                if not len(word):
                    break
            at = np.flatnonzero(rank == np.repeat(best, n))
            at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])]
            piece[at] = made[at]
            keep = np.ones(len(word), bool)
            keep[at + 1] = False
            word, piece, rank, made = word[keep], piece[keep], rank[keep], made[keep]
            at -= np.arange(len(at))  # of the new pieces now
            rank[at] = self.NONE
            near = np.concatenate([at, at - 1])
            near = near[(near >= 0) & (near + 1 < len(word))]
            near = near[word[near] == word[near + 1]]
            rank[near], made[near] = self.look_up(piece[near], piece[near + 1])
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        word, piece = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return piece[order], np.cumsum(np.bincount(word, minlength=len(words)))


class Pieces:
    """The vocabulary and the solver of units and chunks."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=model)
        own = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id = {sp.id_to_piece(i): i for i in own}
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in own}
        self.longest = max(map(len, self.id))
        self.byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.text = [b""] * sp.get_piece_size()
        for p, i in self.id.items():
            self.text[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte_id.items():
            self.text[i] = bytes([b])
        self.text[self.unknown] = " ⁇ ".encode()
        joined = {c for p in self.id if len(p) > 1 for c in p}
        if any(a != SPACE and b == SPACE for p in self.id for a, b in zip(p, p[1:], strict=False)) or "\n" in joined:
            raise ValueError("the vocabulary has pieces across word starts or line ends")
        self.joined = joined
        self.names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.root: dict = {}
        for p, i in self.id.items():
            node = self.root
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = i
        # marks that no piece joins to a letter or the like: a border between the two is never crossed
        beside = {(a, b) for p in self.id for a, b in zip(p, p[1:], strict=False)}
        beside |= {(b, a) for a, b in beside}
        punctuation = set(string.punctuation)
        joins = {a for a, b in beside if a in punctuation and b not in punctuation and b != SPACE}
        mark, other = (re.escape("".join(sorted(x))) or "\0" for x in (punctuation - joins, joins))
        a = f"[^{SPACE}\n{mark}{other}]"
        self.unit = re.compile(
            f"{SPACE}*{a}+(?=[{SPACE}\n{mark}]|$)|{SPACE}*[{mark}]+(?={a}|[{SPACE}\n]|$)|{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n"
        )
        self.units: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.chars: dict[str, int] = {}
        # (number of a piece, number of the next) -> (rank, number) of the piece that both make; the best score has the least rank
        rank = {x: k for k, x in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.pair = {
            self.number(p[:k]) << BITS | self.number(p[k:]): (rank[x], self.id[p])
            for p, x in self.score.items() for k in range(1, len(p)) if all(len(y) == 1 or y in self.id for y in (p[:k], p[k:]))
        }
        self.pairs_table = Pairs(self.pair, {p: i for p, i in self.id.items() if len(p) == 1})
        self.heads: dict[str, list[int]] = {}
        self.pairs: dict[int, bool] = {}
        self.selfs: dict[str, bool] = {}

    def merged(self, s: str) -> list[int]:
        """BPE by its definition: merge the best pair, the leftmost of equals, until there is none. Numbers of pieces."""
        parts, pair, none = [self.char(c) for c in s], self.pair.get, NO_PAIR
        pairs = [pair(a << BITS | b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (best := min(pairs)) is not none:
            i = pairs.index(best)
            new = parts[i] = best[1]
            del parts[i + 1], pairs[i]
            if i:
                pairs[i - 1] = pair(parts[i - 1] << BITS | new, none)
            if i < len(pairs):
                pairs[i] = pair(new << BITS | parts[i + 1], none)
        return parts

    def char(self, c: str) -> int:
        x = self.chars.get(c)
        if x is None:
            x = self.chars[c] = self.number(c)
        return x

    def merge(self, s: str) -> list[str]:
        return [self.name(t) for t in self.merged(s)]

    def stands(self, p: str) -> bool:
        """Is p a piece that encodes to itself; single characters always are."""
        if len(p) == 1:
            return True
        if p not in self.id:
            return False
        if (x := self.selfs.get(p)) is None:
            x = self.selfs[p] = self.merge(p) == [p]
        return x

    def number(self, p: str) -> int:
        """A piece's id; NO_PIECE + its code point for a character without one; BEGIN for ''."""
        return self.id[p] if p in self.id else NO_PIECE + ord(p) if p else BEGIN

    def name(self, t: int) -> str:
        return self.names[t] if t < NO_PIECE else "" if t == BEGIN else chr(t - NO_PIECE)

    def follows(self, key: int) -> bool:
        """May the second of the two numbers in key follow the first."""
        a, b = self.name(key >> BITS), self.name(key & BEGIN)
        if len(self.pairs) > CACHED_PAIRS:
            self.pairs.clear()
        x = self.stands(b) and (not a or (not self.stands(a + b) and self.merge(a + b) == [a, b]))
        self.pairs[key] = x
        return x

    def ids(self, t: int) -> list[int]:
        if t < NO_PIECE:
            return [t]
        b = [self.byte_id.get(x) for x in chr(t - NO_PIECE).encode()]
        return [self.unknown] if None in b else b

    def chain(self, s: str, begin: int, last: str, end: int, known: list[list] | None = None) -> list[int]:
        """For each place up to ``end``: the last piece of the one path from ``begin``, after the piece ``last``; or -1.

        known: chains over the same text; from where this one has run along with one of them for a piece's length, it
        goes on as that one does.
        """
        got = [-1] * (end + 1)
        got[begin] = self.number(last)
        return self._extend(s, begin, begin + 1, got, known)

    def _extend(self, s: str, begin: int, first: int, got: list[int], known: list[list] | None = None) -> list[int]:
        """Fill got from place ``first`` on. Pieces are found by their last character, in a trie of reversed pieces."""
        along = [0] * len(known or ())
        root, pairs, follows = self.root, self.pairs, self.follows
        for p in range(first, len(got)):
            node, q = root, p
            while q > begin:
                q -= 1
                node = node.get(s[q])
                if node is None:
                    if q < p - 1:
                        break
                    t, node = NO_PIECE + ord(s[q]), {}
                else:
                    t = node.get("")
                    if t is None:
                        if q < p - 1:
                            continue
                        t = NO_PIECE + ord(s[q])
                if got[q] >= 0:
                    key = got[q] << BITS | t
                    x = pairs.get(key)
                    if x or (x is None and follows(key)):
                        got[p] = t
                        break
            for i, k in enumerate(known or ()):
                along[i] = along[i] + 1 if k[p] == got[p] >= 0 else 0
                if along[i] > self.longest:
                    got[p + 1 :] = k[p + 1 :]
                    return got
        return got

    def back(self, got: list[int], begin: int, end: int) -> list[int]:
        out, p = [], end
        while p > begin:
            out.append(got[p])
            p -= len(self.name(got[p]))
        return out[::-1]

    def _pack(self, pieces: list[int]) -> bytes:
        return np.array([i for p in pieces for i in self.ids(p)], np.int32).tobytes()

    def solve(self, u: str) -> bytes:
        """Ids of a unit."""
        if len(u) <= SHORT_UNIT:
            parts = self.merged(u)
            return array("i", parts).tobytes() if max(parts) < NO_PIECE else self._pack(parts)
        # what ends in the first characters depends on them alone
        head = self.heads.get(u[:HEAD])
        if head is None:
            if len(self.heads) > CACHED_HEADS:
                self.heads.clear()
            head = self.heads[u[:HEAD]] = self.chain(u, 0, "", HEAD)
        return self._pack(self.back(self._extend(u, 0, len(head), head + [-1] * (len(u) - HEAD)), 0, len(u)))

    def encode_unit(self, u: str) -> bytes:
        x = self.units.get(u)
        if x is None:
            x = self.solve(u)
            if len(u) <= 64:
                self.units[u] = x
        return x

    def encode_clean(self, s: str) -> bytes:
        """Encoding of a normalised text between two borders that no piece crosses."""
        if len(self.units) > CACHED_UNITS:
            self.units.clear()
        units, get = self.unit.findall(s), self.units.get
        return b"".join([get(u) or self.encode_unit(u) for u in units])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Encodings of whole texts. No piece crosses the border before a space, unless that comes after another; so words
        are solved once, those that are not known yet all together."""
        if len(self.words) > CACHED_UNITS:
            self.words.clear()
        parts = [None if not t or "  " in t or t[0] == " " or SPACE in t else t.split(" ") for t in texts]
        new = set().union(*(x for x in parts if x)).difference(self.words)
        own = []
        for w in new:
            if len(w) < SHORT_UNIT:
                own.append(w)
            else:
                self.words[w] = self.encode_clean(SPACE + w)
        pieces, ends = self.pairs_table.merge([SPACE + w for w in own])
        odd = np.unique(np.searchsorted(ends, np.flatnonzero(pieces >= NO_PIECE), "right")).tolist()
        line, edge = pieces.tobytes(), [0, *(4 * ends).tolist()]
        self.words.update((w, line[a:b]) for w, a, b in zip(own, edge, edge[1:], strict=False))
        for k in odd:  # with characters that are written as bytes
            self.words[own[k]] = self._pack(pieces[edge[k] // 4 : edge[k + 1] // 4].tolist())
        known = self.words.__getitem__
        out = [b"".join(map(known, x)) if x else self.encode_clean(normalise(t)) for x, t in zip(parts, texts, strict=True)]
        for w in [w for w in new if len(w) > 64]:
            del self.words[w]
        return out

    def safe(self, s: str, p: int) -> bool:
        """No piece crosses the border before s[p]."""
        return p in (0, len(s)) or (s[p] == SPACE and s[p - 1] != SPACE) or s[p] not in self.joined or s[p - 1] not in self.joined

    # chunks

    def _inner(self, s: str, b: int, e: int) -> tuple[int, int] | None:
        """The first and the last safe border strictly inside."""
        first = next((p for p in range(b + 1, e) if self.safe(s, p)), None)
        return None if first is None else (first, next(p for p in range(e - 1, b, -1) if self.safe(s, p)))

    def entries(self, s: str, b: int) -> list[tuple[str, int]]:
        """States (piece, characters beyond the border) that the border before s[b] may have."""
        return [
            (s[x:y], y - b)
            for x in range(max(0, b - self.longest), b)
            for y in range(b, min(len(s), x + self.longest) + 1)
            if y > x and self.stands(s[x:y])
        ]

    def exits(self, got: list[int], e: int, limit: int, last: bool) -> list[tuple[str, int]]:
        if last:
            return [CLEAN] if got[e] >= 0 else []
        ends = ((p, self.name(got[p])) for p in range(e, min(limit, e + self.longest) + 1) if got[p] >= 0)
        return [(t, p - e) for p, t in ends if t and p - len(t) < e]

    def transfer(self, s: str, b: int, e: int, first: bool, last: bool) -> Matrix:
        """Max-plus matrix of the chunk s[b:e], the first or last of its text or not: by entry and exit, the score of the
        pieces that begin in it. s has the chunk's neighbourhood of one piece's length on both sides.
        """
        starts = [CLEAN] if first else self.entries(s, b)
        ahead = e if last else min(len(s), e + self.longest)
        inner = self._inner(s, b, e)
        if inner is None:
            known: list[list] = []
            cells: dict = {}
            for t, over in starts:
                got = self.chain(s, b + over, t, ahead, known)
                known.append(got)
                for x in self.exits(got, e, ahead, last):
                    cells[(t, over), x] = self._weight(got, b + over, e + x[1])
            return Matrix(cells=cells)
        f, g = inner
        left, tail = {}, self.chain(s, g, "", ahead)
        right = {x: self._weight(tail, g, e + x[1]) for x in self.exits(tail, e, ahead, last)}
        for t, over in starts:
            got = self.chain(s, b + over, t, f) if b + over <= f else None
            if got and got[f] >= 0:
                left[t, over] = self._weight(got, b + over, f)
        return Matrix(left=left, right=right)

    def _weight(self, got, begin, end) -> float:
        return float(sum(self.score.get(self.name(p), 0.0) for p in self.back(got, begin, end)))

    def encode_chunk(self, s: str, b: int, e: int, entry: tuple[str, int], exit: tuple[str, int]) -> bytes:
        begin, end = b + entry[1], e + exit[1]
        if entry == CLEAN == exit:
            return self.encode_clean(s[b:e])
        inner = self._inner(s, b, e)
        parts = [(begin, entry[0], end)] if inner is None else [(begin, entry[0], inner[0]), None, (inner[1], "", end)]
        out = []
        for part in parts:
            if part is None:
                out.append(self.encode_clean(s[inner[0] : inner[1]]))
                continue
            x, t, y = part
            pieces = self.back(self.chain(s, x, t, y), x, y)
            out.append(self._pack(pieces))
        return b"".join(out)

    def plain(self, text: bytes) -> str:
        """The text of joined pieces, without the space put in front."""
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")

    def decode(self, ids) -> str:
        return self.plain(b"".join(map(self.text.__getitem__, ids)))


class Matrix:
    """A sparse max-plus matrix between states: cells {(entry, exit): score}, or of rank one, entries left and exits
    right, with the score left[entry] + right[exit]."""

    def __init__(self, cells: dict | None = None, left: dict | None = None, right: dict | None = None):
        self.cells, self.left, self.right = cells, left, right

    def __matmul__(self, other: Matrix) -> Matrix:
        if self.cells is None and other.cells is None:
            top = max((v + other.left[m] for m, v in self.right.items() if m in other.left), default=None)
            return Matrix(left={} if top is None else {e: v + top for e, v in self.left.items()}, right=other.right)
        if self.cells is None:
            return Matrix(left=self.left, right=other.after(self.right)[0])
        by: dict = {}
        for (e, m), v in self.cells.items():
            by.setdefault(e, {})[m] = v
        if other.cells is None:
            tops = {e: max((v + other.left[m] for m, v in row.items() if m in other.left), default=None) for e, row in by.items()}
            return Matrix(left={e: v for e, v in tops.items() if v is not None}, right=other.right)
        return Matrix(cells={(e, x): v for e, row in by.items() for x, v in other.after(row)[0].items()})

    def after(self, vector: dict) -> tuple[dict, dict]:
        """The scores of the exits after those of the entries, and the entry that each comes from."""
        if self.cells is None:
            top = max(((v + self.left[m], m) for m, v in vector.items() if m in self.left), default=None)
            return ({}, {}) if top is None else ({x: top[0] + v for x, v in self.right.items()}, dict.fromkeys(self.right, top[1]))
        score: dict = {}
        back: dict = {}
        for (m, x), w in self.cells.items():
            if m in vector and (x not in score or vector[m] + w > score[x]):
                score[x], back[x] = vector[m] + w, m
        return score, back

    def dump(self) -> str:
        flat = lambda d: [[*k, v] for k, v in d.items()]
        return json.dumps([flat(self.left), flat(self.right)] if self.cells is None else [[*a, *b, v] for (a, b), v in self.cells.items()] + [None])

    @classmethod
    def load(cls, text: str) -> Matrix:
        x = json.loads(text)
        if x and x[-1] is None:
            return cls(cells={((a, i), (b, j)): v for a, i, b, j, v in x[:-1]})
        return cls(left={(p, o): v for p, o, v in x[0]}, right={(p, o): v for p, o, v in x[1]})


def product(matrices: list[Matrix]) -> Matrix:
    out = matrices[0]
    for m in matrices[1:]:
        out = out @ m
    return out


def borders(matrices: list[Matrix], entry: tuple[str, int] = CLEAN, exit: tuple[str, int] = CLEAN) -> list[tuple[str, int]]:
    """The states before each of the matrices and after the last: those of the best path from ``entry`` to ``exit``."""
    vector, backs = {entry: 0.0}, []
    for m in matrices:
        vector, back = m.after(vector)
        backs.append(back)
    states = [exit]
    for back in reversed(backs):
        states.append(back[states[-1]])
    return states[::-1]


_loaded: dict[int, Pieces] = {}


def _pieces(model: bytes) -> Pieces:
    if hash(model) not in _loaded:
        _loaded.clear()
        _loaded[hash(model)] = Pieces(model)
    return _loaded[hash(model)]


def normalise(text: str | None) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def _ids(parts: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(parts), np.int32))


def encode(docs: DataFrame, model_path: str = MODEL_PATH, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``docs`` with n_tokens and token_ids of its column text."""
    common.tune(docs.sparkSession)
    model = Path(model_path).read_bytes()
    names = [c for c in docs.columns if c not in ("n_tokens", "token_ids")]
    base = docs.select(*names)
    schema = T.StructType(base.schema.fields + RESULT)
    long_text = F.coalesce(F.length("text"), F.lit(0)) > chunk_chars

    def short(batches):
        p = _pieces(model)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in common.cut([len(t or "") for t in texts], 1 << 20):
                ids = p.encode(texts[i:j])
                part = batch.slice(i, j - i)
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, counts, _ids(ids)], [*names, "n_tokens", "token_ids"])

    near = base.where(~long_text).mapInArrow(short, schema)
    return near.unionByName(_encode_long(base.where(long_text), model, chunk_chars, names, schema))


KEY = common.OWN + "key"
_STATE = "struct<piece:string,over:int>"
_ARROW_STATE = pa.struct([("piece", pa.string()), ("over", pa.int32())])


def _pair(x) -> tuple[str, int]:
    return x["piece"], x["over"]


def chunks_of(rows: DataFrame, model: bytes, chunk_chars: int) -> DataFrame:
    """key, k, slice, b, e, last of each chunk of the texts of ``rows`` (key, text): s[b:e] of a slice that has a piece's
    length more on both sides. In buckets by (key, k), so that what comes back to a chunk doesn't move its text."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
    names = ["key", "k", "slice", "b", "e", "last"]

    def split(batches):
        p = _pieces(model)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s, own = normalise(text), []
                for k, b in enumerate(range(0, len(s), chunk_chars)):
                    e, x = min(len(s), b + chunk_chars), max(0, b - p.longest)
                    own.append((key, k, s[x : e + p.longest], b - x, e - x, e == len(s)))
                for i in range(0, len(own), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*own[i : i + 64], strict=True), kinds, strict=True)], names)

    cut = rows.mapInArrow(split, "key long, k int, slice string, b int, e int, last boolean")
    return common.bucketed(cut.repartition(n, "key", "k"), ["key", "k"], "pieces-chunks")


def chunk_matrices(chunks: DataFrame, model: bytes) -> DataFrame:
    """key, k, m: the matrix of every chunk."""

    def run(batches):
        p = _pieces(model)
        for batch in batches:
            m = [p.transfer(r["slice"], r["b"], r["e"], r["k"] == 0, r["last"]).dump() for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), pa.array(m, pa.string())], ["key", "k", "m"])

    return chunks.mapInArrow(run, "key long, k int, m string")


def _fans(level: DataFrame) -> DataFrame:
    """key, k, ms: up to FAN neighbours of a level, under their number in the next one."""
    up = F.floor(F.col("k") / FAN).cast("int").alias("k")
    return level.select("key", up, F.struct(F.col("k").alias("at"), "m").alias("x")).groupBy("key", "k").agg(F.sort_array(F.collect_list("x")).alias("ms"))


def border_states(matrices: DataFrame) -> DataFrame:
    """key, k, entry, exit: the states around every chunk, by a scan up and down trees of fan FAN."""

    def multiply(batches):
        for batch in batches:
            m = [product([Matrix.load(x["m"]) for x in ms]).dump() for ms in batch.column("ms").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), pa.array(m, pa.string())], ["key", "k", "m"])

    def trace(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                got = borders([Matrix.load(x["m"]) for x in r["ms"]], _pair(r["entry"]), _pair(r["exit"]))
                rows += [(r["key"], x["at"], *({"piece": t, "over": o} for t, o in pair)) for x, pair in zip(r["ms"], zip(got, got[1:], strict=False), strict=True)]
            kinds = [pa.int64(), pa.int32(), _ARROW_STATE, _ARROW_STATE]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["key", "k", "entry", "exit"])

    levels = [common.written(matrices, "pieces-matrices")]
    most = levels[0].agg(F.max("k")).head()[0] or 0
    while most >= FAN:
        levels.append(common.written(_fans(levels[-1]).mapInArrow(multiply, "key long, k int, m string"), "pieces-products"))
        most //= FAN
    clean = F.lit(json.dumps({"piece": "", "over": 0}))
    states = levels[-1].select("key", F.lit(0).alias("k")).distinct().withColumns({c: F.from_json(clean, "piece string, over int") for c in ("entry", "exit")})
    for level in reversed(levels):
        states = common.written(_fans(level).join(states, ["key", "k"]).mapInArrow(trace, f"key long, k int, entry {_STATE}, exit {_STATE}"), "pieces-states")
    return states


def _encode_long(docs: DataFrame, model: bytes, chunk_chars: int, names: list[str], schema: T.StructType) -> DataFrame:
    # the rows are written once: their keys must not change between the passes
    rows = common.written(docs.withColumn(KEY, F.monotonically_increasing_id()), "pieces-rows")
    chunks = chunks_of(rows.select(F.col(KEY).alias("key"), "text"), model, chunk_chars)
    states = border_states(chunk_matrices(chunks, model))

    def solve(batches):
        p = _pieces(model)
        for batch in batches:
            ids = [p.encode_chunk(r["slice"], r["b"], r["e"], _pair(r["entry"]), _pair(r["exit"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), _ids(ids)], ["key", "k", "ids"])

    solved = (
        chunks.join(states.hint("merge"), ["key", "k"])
        .select("key", "k", "slice", "b", "e", "entry", "exit")
        .mapInArrow(solve, "key long, k int, ids array<int>")
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))
        .select(F.col("key").alias(KEY), F.flatten(F.transform("parts", lambda x: x["ids"])).alias("token_ids"))
    )
    out = rows.join(solved, KEY).withColumn("n_tokens", F.size("token_ids").cast("long"))
    return out.select(*schema.fieldNames())


def decode(rows: DataFrame, model_path: str = MODEL_PATH, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of the pieces in ``ids`` as column ``out``."""
    common.tune(rows.sparkSession)
    model = Path(model_path).read_bytes()
    names = [c for c in rows.columns if c != out]
    schema = T.StructType([rows.schema[c] for c in names] + [T.StructField(out, T.StringType())])

    def run(batches):
        p = _pieces(model)
        sizes, table = np.array([len(b) for b in p.text], np.int64), pa.array(p.text, pa.large_binary())
        for batch in batches:
            lists = batch.column(ids)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            texts = []
            for i, j in common.cut(counts, 1 << 20):
                flat = lists.slice(i, j - i).flatten().to_numpy()
                line = bytes(table.take(pa.array(flat)).buffers()[2] or b"")
                edge = np.concatenate([[0], np.cumsum(sizes[flat])])[np.concatenate([[0], np.cumsum(counts[i:j])])].tolist()
                texts += [p.plain(line[a:b]) for a, b in zip(edge, edge[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], [*names, out])

    return rows.mapInArrow(run, schema)


def op4_sentencepiece(spark, sf_dir):
    """Ids of every text and whether they decode to it."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    done = encode(docs).select("doc_id", "n_tokens", "token_ids", F.sha2("text", 256).alias("sha"))
    return decode(done).select("doc_id", "n_tokens", "token_ids", (F.sha2("decoded", 256) == F.col("sha")).alias("round_trip"))


def stage_pieces(spark, docs, sf_dir):
    return encode(docs)
