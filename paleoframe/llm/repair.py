"""Repair of conversation structure: the cheapest edits that make the roles of turns alternate as they should.

The rows of a conversation and the states of its role machine span a lattice: every row is kept, given the role that is
due, or deleted, and a turn with an empty text may be inserted anywhere. A* searches it from the beginning. Its heuristic
is the suffix sum of what every way still has to pay: the deletions that are required and, for a truncated row, the cheaper
of deleting it and keeping it truncated. Nodes leave the queue by (cost plus heuristic, audit), so that of all
cheapest ways the one with the least audit comes first. Audits are not spelled out in the queue: a node knows its letter
and the node before, and two audits are compared where they part, found by jumps in logarithmic time.

Rows are dealt out by conversation and sorted by Spark; a worker reads them as a stream and keeps one byte a row for the
search and a digest a row for duplicates; the texts of the conversation at hand wait in a buffer that spills to the
task's own disk. The audit has a letter a row and the result one SHA-256 over all of it, so a conversation is one task.

Defined results: nulls count as one space, so a null text is blank and a null role is none of the known ones; rows with a
null id are one conversation; rows of one turn are ordered by role and text, rows with no turn come first; an empty role
has no initial and is never legal; repeated rows are duplicates; a conversation that loses all rows has zeros, an empty
audit and the hash of an empty string; an empty table gives no rows; columns other than the four named ones are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: The machine of `(s?(ua)+)?`: state -> initial -> state; the initial that a rerole or an insertion gives; accepting states.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
DUE = ("u", "u", "a", "u")
ACCEPT = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = ("su", "ua", "au")
SPACES = " \t\n\x0b\x0c\r"
#: Faults of a row.
NONE, BLANK, DUPLICATE, CUT = range(4)
#: Bytes of a conversation's texts in memory before they go to disk, and of a conversation's codes up to which its
#: repair is remembered, for the many that share them.
SPOOL, REMEMBERED = 16_000_000, 64

RESULT = [T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [
    T.StructField(c, T.StringType()) for c in ("audit", "repaired_sha256")
]


class Node:
    """A way to a place of the lattice, as a node of the tree of all audits."""

    __slots__ = ("before", "jump", "depth", "letter")

    def __init__(self, before: Node | None, letter: str):
        self.before, self.letter = before, letter
        if before is None:
            self.depth, self.jump = 0, self
        else:
            self.depth = before.depth + 1
            far = before.jump
            # jumps as long as the two before them, if these are of one length
            self.jump = far.jump if before.depth - far.depth == far.depth - far.jump.depth else before

    def __lt__(self, other: Node) -> bool:
        a, b, shorter = self, other, self.depth < other.depth
        while a.depth > b.depth:
            a = a.jump if a.jump.depth >= b.depth else a.before
        while b.depth > a.depth:
            b = b.jump if b.jump.depth >= a.depth else b.before
        if a is b:  # one audit begins with the other
            return shorter
        while a.before is not b.before:
            a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.before, b.before)
        return a.letter < b.letter

    def audit(self) -> str:
        letters, node = [], self
        while node.before is not None:
            letters.append(node.letter)
            node = node.before
        return "".join(reversed(letters))


def search(codes: bytes) -> tuple[int, str]:
    """The cheapest cost and the least audit of that cost, by A*. codes, one a row: its initial's place in `sua` from 1
    on (0: another), 4 more if it is truncated, 8 more if it has to go."""
    n = len(codes)
    row = np.frombuffer(codes, np.uint8)
    charge = np.where(row & 8, DELETE, np.where(row & 4, min(DELETE, TRUNCATED), 0))
    left = np.concatenate([np.cumsum(charge[::-1])[::-1], [0]]).tolist()
    queue = [(left[0], Node(None, ""), 0, 0)]
    done: set[int] = set()
    while True:
        f, node, i, q = heapq.heappop(queue)
        if i == n and q in ACCEPT:
            return f, node.audit()
        if 4 * i + q in done:
            continue
        done.add(4 * i + q)
        g = f - left[i]
        due = NEXT[q][DUE[q]]
        ways = [("I", INSERT, i, due)]
        if i < n:
            c = codes[i]
            ways.append(("D", DELETE, i + 1, q))
            if not c & 8:
                cut = TRUNCATED if c & 4 else 0
                ways.append(("R", REROLE + cut, i + 1, due))
                to = NEXT[q].get(" sua"[c & 3])
                if to is not None:
                    ways.append(("K", KEEP + cut, i + 1, to))
        for letter, cost, j, to in ways:
            if 4 * j + to not in done:
                heapq.heappush(queue, (g + cost + left[j], Node(node, letter), j, to))


_remembered = lru_cache(maxsize=65_536)(search)


def repair(codes: bytes) -> tuple[int, str]:
    return _remembered(codes) if len(codes) <= REMEMBERED else search(codes)


def roles(audit: str, own):
    """(role or None for its own, whether it is inserted) of every turn that ``audit`` leaves; own: initials by row."""
    q, i = 0, 0
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        to = own[i] if letter == "K" else DUE[q]
        yield (i if letter != "I" else None), (None if letter == "K" else ROLES[to])
        q = NEXT[q][to]
        i += letter != "I"


class Conversation:
    """What is kept of the rows of one conversation, as they come."""

    def __init__(self):
        self.codes, self.initials, self.digests = bytearray(), bytearray(), bytearray()
        self.texts, self.ends = tempfile.SpooledTemporaryFile(SPOOL), []
        self.low = self.high = self.last = None
        self.distinct = 0

    def add(self, turn, role: str, text: str, blank: bool, cut: bool) -> None:
        if turn is not None and turn != self.last:
            self.low = turn if self.low is None else self.low
            self.high, self.last, self.distinct = turn, turn, self.distinct + 1
        first, row = role[:1], f"{role}:{text}".encode()
        self.initials.append("sua".find(first) + 1 if first else 0)
        self.codes.append(1 if blank else 2 if cut else 0)
        # the length of the role parts role and text in the digest
        self.digests += hashlib.blake2b(b"%d:" % len(role) + row, digest_size=16).digest()
        self.texts.write(row)
        self.ends.append((len(role.encode()), len(row)))

    def finish(self) -> list:
        n = len(self.codes)
        fault = np.frombuffer(bytes(self.codes), np.uint8).astype(np.int64)
        initial = np.frombuffer(bytes(self.initials), np.uint8).astype(np.int64)
        digest = np.frombuffer(bytes(self.digests), "V16")
        order = np.lexsort((np.arange(n), *digest.view(np.uint64).reshape(-1, 2).T)) if n else np.zeros(0, np.int64)
        again = np.zeros(n, bool)
        if n:
            again[order[1:]] = digest[order[1:]] == digest[order[:-1]]
        kind = np.where(fault == 1, BLANK, np.where(again, DUPLICATE, np.where(fault == 2, CUT, NONE)))
        pair = initial[:-1] * 4 + initial[1:]
        illegal = n and int((~np.isin(pair, [4 * (" sua".index(a)) + " sua".index(b) for a, b in LEGAL_PAIRS])).sum())
        codes = (initial + 4 * (kind == CUT) + 8 * ((kind == BLANK) | (kind == DUPLICATE))).astype(np.uint8).tobytes()
        cost, audit = repair(codes)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return [gaps, *(int((kind == k).sum()) for k in (BLANK, DUPLICATE, CUT)), int(illegal), cost, audit, self._hash(audit)]

    def _hash(self, audit: str) -> str:
        h, at, place, first = hashlib.sha256(), 0, 0, True
        self.texts.seek(0)
        for i, role in roles(audit, [" sua"[k] for k in self.initials]):
            h.update(b"" if first else b"\n")
            first = False
            if i is None:
                h.update(f"{role}:".encode())
                continue
            while at < i:
                place += self.ends[at][1]
                at += 1
            self.texts.seek(place)
            row = self.texts.read(self.ends[i][1])
            h.update(row if role is None else role.encode() + row[self.ends[i][0] :])
        self.texts.close()
        return h.hexdigest()


def repair_conversations(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """conv_id and RESULT for each conversation of ``rows`` (conv_id, turn, role, text). conversations: those to answer
    for, which may have lost all their rows; its column conv_id may repeat."""
    spark = rows.sparkSession
    common.tune(spark)
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    solid = F.rtrim(text, F.lit(SPACES))
    turns = rows.select(
        "conv_id", F.lit(True).alias("has"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        (solid == "").alias("blank"), (~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    if conversations is not None:
        none = [F.lit(None).cast(t).alias(c) for c, t in turns.dtypes[2:]]
        turns = turns.unionByName(conversations.select("conv_id").distinct().select("conv_id", F.lit(False).alias("has"), *none))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    dealt = turns.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id").sortWithinPartitions(*order)
    schema = T.StructType([rows.schema["conv_id"], *RESULT])
    names = schema.fieldNames()

    def run(batches):
        conv = held = kind = None

        def made(out):
            types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], names)

        for batch in batches:
            out, kind = [], batch.schema.field("conv_id").type
            for i, has, turn, role, text, blank, cut in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or i != conv:
                    if held is not None:
                        out.append([conv, *held.finish()])
                    conv, held = i, Conversation()
                if has:
                    held.add(turn, role, text, blank, cut)
            yield made(out)
        if held is not None:
            yield made([[conv, *held.finish()]])

    return dealt.mapInArrow(run, schema)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with faults put in by crc32 of `conv_id:turn`, modulo 20; nulls become one space."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (
        rows.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), k.alias("k"))
        .where("k <> 0")
        .select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("k") == 3, 2).otherwise(1))).alias("copy"))
        .drop("copy")
    )


def op11_repair(spark, sf_dir):
    rows = common.table(spark, sf_dir, "conversations")
    return repair_conversations(damaged(rows), rows)


_EDITS = ", ".join(
    f"({q}, '{op}', {f"'{c}'" if c else 'NULL'}, {f"'{ROLES[r]}'" if r else 'NULL'}, {t}, {cost}, '{letters}', {ins}::VARCHAR[])"
    for q in range(4)
    for op, c, r, t0, cost0 in [("D", "", "", q, DELETE), ("R", "", DUE[q], NEXT[q][DUE[q]], REROLE), *(("K", c, "", t, KEEP) for c, t in NEXT[q].items())]
    for n in range(3)
    for t, cost, letters, ins in [
        (
            (t0, NEXT[t0][DUE[t0]], NEXT[NEXT[t0][DUE[t0]]][DUE[NEXT[t0][DUE[t0]]]])[n],
            cost0 + INSERT * n,
            op + "I" * n,
            [f"{ROLES[x]}:" for x in (DUE[t0], DUE[NEXT[t0][DUE[t0]]])[:n]],
        )
    ]
)
OP11_SQL = rf"""
WITH RECURSIVE steps(i, k, c) AS (SELECT i, 0, i FROM (SELECT unnest(range(256)) AS i) UNION ALL
      SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8)
  , crc AS (SELECT list(c ORDER BY i) AS tab FROM steps WHERE k = 8)
  , src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations)
  , keyed AS (SELECT *, xor(list_reduce(list_prepend(4294967295, [CAST(ascii(c) AS BIGINT) FOR c IN string_split(name, '')]),
      lambda c, y: xor(c >> 8, tab[xor(c & 255, y) + 1])), 4294967295) % 20 AS k FROM src, crc)
  , hurt AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
      CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM keyed WHERE k <> 0)
  , placed AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid, left(role, 1) AS c,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt)
  , again AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM placed)
  , judged AS (SELECT *, CASE WHEN solid = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
      c || lead(c) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM again)
  , counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
      count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
      count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
  , edits(q, op, c, role, t, cost, letters, ins) AS (VALUES {_EDITS})
  , way(conv_id, i, q, best) AS (
      SELECT conv_id, 0::BIGINT, q, s FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES
        (0, {{'cost': 0::BIGINT, 'audit': '', 'turns': []::VARCHAR[]}}), (2, {{'cost': {INSERT}::BIGINT, 'audit': 'I', 'turns': ['user:']}}),
        (3, {{'cost': {2 * INSERT}::BIGINT, 'audit': 'II', 'turns': ['user:', 'assistant:']}})) AS begun(q, s)
    UNION ALL
      SELECT w.conv_id, w.i + 1, e.t, min({{'cost': w.best.cost + e.cost + CASE WHEN e.op <> 'D' AND j.fault = 3 THEN {TRUNCATED} ELSE 0 END,
        'audit': w.best.audit || e.letters, 'turns': w.best.turns || CASE WHEN e.op = 'D' THEN [] ELSE [coalesce(e.role, j.role) || ':' || j.text] END || e.ins}})
      FROM way w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1
      JOIN edits e ON e.q = w.q AND (e.c IS NULL OR e.c = j.c) AND (e.op = 'D' OR j.fault IN (0, 3)) GROUP BY 1, 2, 3)
  , ends AS (SELECT w.conv_id, min(w.best) AS best FROM way w LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM w.conv_id
      WHERE w.i = coalesce(n.n, 0) AND w.q IN (0, 3) GROUP BY 1)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, best.cost AS cost, best.audit AS audit, sha256(array_to_string(best.turns, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM e.conv_id
"""
