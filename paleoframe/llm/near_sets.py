"""Near-copies by exact similarity of word shingles.

Two texts are near-copies if the Jaccard similarity of their sets of five-word shingles (as XXH64 hashes) is 0.8 or more.
Every such pair is reached:

1. Equal sets are one node from here on. Equal texts are met by their hashes alone: a set is made and moved once a task.
2. Sets of sizes a and b with that similarity differ in at most (a + b) / 9 shingles, and their sizes lie in one of the
   classes of ratio 1.25 or in two that follow each other; a slot is made for each class and the class before it. In a
   slot all sets are cut by hash into the same number of buckets, more than can differ, so near-copies have some equal
   buckets; of each set only as many are listed, the fullest first, as must contain one of those (prefix filter).
3. Sets with an equal bucket meet in a group. Each set has the fingerprint of op6_simhash, made of its shingles. In a group
   the table of distances to the pivots gives the sets that differ in at most BITS_APART bits (simhash.near_pairs), and
   each set is compared with at most one other: of the earlier ones found so, the one with the fewest bits apart. Where the
   table finds none, it is a candidate among the WINDOW first sets of a group. This joins most of a large group by few
   links. A pair is a candidate if it passes a bound: the sizes, and the parities of shingles in SKETCH classes, which
   differ in at most as many classes as the sets in shingles.
4. Similarity does not bound the bits apart, so what is left is compared exactly: all candidates that are not yet in one
   component. Inside a cell a comparison is left out as soon as its two components are one, so that only links of a
   forest leave a task, however many pairs of a group are similar. Every comparison intersects the two whole sets. SKETCH
   classes tell nothing of sets of over 9 / 4 * SKETCH shingles, so candidates have to pass the bound by the parities
   in classes that grow with the set (`fine`) before their sets move.

No group is gathered whole. For the partners a group over DEAL nodes is dealt out to several tasks, each of which
has the group's first nodes besides its own. Afterwards a group over BLOCK nodes is parted into blocks: a component of
more nodes has blocks of its own, the others share blocks, and pairs of blocks meet in cells. Blocks of one component
never meet, so a large group that is one component but for a few nodes is compared with these few only. The sets
themselves move only with nodes that have a candidate, to cells of HELD shingles at most.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .graph import connected_components, whole_groups
from .ngrams import mix
from .simhash import SEED, majority, near_pairs, shingle_hashes

WORDS = 5
SKETCH = 512
#: A fine sketch has two to four classes a shingle, and so many at most.
CLASSES = 1 << 20
#: Near-copies are looked for among fingerprints so many bits apart: 292 of 293 pairs counted differed in 3 to 11.
BITS_APART = 12
#: Of a group, so many sets are looked at for the first partners of the others.
WINDOW = 256
#: Of each set, so many of its least keys tell whether a pair has met before; pairs that they miss are listed twice.
LEAST_KEYS = 16
#: Of a group, so many nodes look for their partners in one task, and so many are one block of open candidates.
DEAL, BLOCK = 8192, 2048
#: A task that compares open candidates holds sets of so many shingles of one cell, or two sets that have more.
HELD = 1 << 22
#: A task that makes sets remembers so many texts and nodes, then begins anew.
SEEN = 1 << 20
_SLOT, _BUCKET = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _bounds() -> list[int]:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, -(-out[-1] * 5 // 4)))
    return out


#: Where the classes of sizes begin.
BOUNDS = np.array(_bounds(), np.int64)


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the text's shingles; a text of fewer words is one shingle."""
    parts = list(shingle_hashes(text, words))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of 0.8 or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * both >= 4 * (len(a) + len(b))


def keys(own: np.ndarray) -> np.ndarray:
    """Of a sorted set: the keys under which it meets all sets similar and not equal to it."""
    n, out, mixed = len(own), [], None
    if not n:
        return own
    at = int(np.searchsorted(BOUNDS, n, "right")) - 1
    for slot in (at, at + 1):
        most = int(BOUNDS[slot + 1]) - 1
        apart, widest = (n + min(n * 5 // 4, most)) // 9, 2 * most // 9
        if not apart or n * 5 // 4 < BOUNDS[slot]:
            continue
        m = widest + 1 + widest // 2
        edge = np.searchsorted(((own >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32), np.arange(m + 1, dtype=np.uint64))
        if mixed is None:
            mixed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(own * _SLOT), dtype=np.uint64)])
        key = mix(mix(mixed[edge[1:]] - mixed[edge[:-1]]) + np.full(m, slot, np.uint64) * _SLOT + np.arange(m, dtype=np.uint64) * _BUCKET)
        out.append(key[np.lexsort((key, -np.diff(edge)))[: apart + 1]])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(own: np.ndarray, classes: int = SKETCH) -> bytes:
    odd = np.bincount((own % np.uint64(classes)).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def fine(own: np.ndarray) -> bytes:
    """A sketch with classes by the size of the set, a power of two."""
    return sketch(own, min(CLASSES, max(SKETCH, 1 << (2 * len(own) - 1).bit_length())))


def fine_close(a: np.ndarray, b: np.ndarray, n: int) -> bool:
    """Whether sets of ``n`` shingles together pass the bound by their fine sketches, which similar sets do."""
    while len(a) != len(b):  # the halves of the longer one, added up, are the sketch with half the classes
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return 9 * int(np.bitwise_count(a ^ b).sum()) <= n


def _sets(column) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in column.to_pylist()]


def _long(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def sets(docs: DataFrame) -> DataFrame:
    """text_hash, node (hash of the set), shingles (the set): each different text once a task, and the set, else null, for
    the first text of the task that has it."""
    from xxhash import xxh64_intdigest

    common.tune(docs.sparkSession)

    def run(batches):
        texts, nodes = set(), set()
        for batch in batches:
            if len(texts) > SEEN:
                texts, nodes = set(), set()
            new = []
            for k, h in enumerate(batch.column(0).to_pylist()):
                if h not in texts:
                    texts.add(h)
                    new.append(k)
            own = [shingle_set(batch.column(1)[k].as_py()).tobytes() for k in new]
            node = [xxh64_intdigest(s, SEED) for s in own]
            for k, x in enumerate(node):
                if x in nodes:
                    own[k] = None
                nodes.add(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(new, pa.int64())), _long(node), pa.array(own, pa.binary())], ["text_hash", "node", "shingles"])

    rows = docs.select(text_hash().alias("text_hash"), F.col("text").cast("string").cast("binary"))
    return rows.mapInArrow(run, "text_hash long, node long, shingles binary")


def text_hash():
    return F.xxhash64(F.col("text").cast("string"))


def _groups(own: DataFrame) -> DataFrame:
    """key, node: the keys that more than one node has."""
    n = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def listed(batches):
        for batch in batches:
            found = [keys(s) for s in _sets(batch.column(1))]
            node = np.repeat(batch.column(0).to_numpy(), [len(k) for k in found])
            yield pa.RecordBatch.from_arrays([_long(np.concatenate(found)), pa.array(node)], ["key", "node"])

    def meet(batches):
        last = None  # key, node and whether it was told
        for batch in batches:
            key, node = (batch.column(c).to_numpy() for c in ("key", "node"))
            told = False
            if last is not None:
                key, node, told = np.concatenate([last[:1], key]), np.concatenate([last[1:2], node]), bool(last[2])
            if not len(key):
                continue
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])  # once in a group
            key, node = key[new], node[new]
            like = key[1:] == key[:-1]
            some = np.concatenate([[False], like]) | np.concatenate([like, [False]])
            last = np.array([key[-1], node[-1], some[-1] or (told and len(key) == 1)])
            some[0] &= not told
            yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(node[some])], ["key", "node"])

    rows = own.select("node", "shingles").mapInArrow(listed, "key long, node long")
    met = rows.repartition(n, "key").sortWithinPartitions("key", "node").mapInArrow(meet, "key long, node long")
    return common.written(met, "near-groups")


def _verified(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """src, dst: those of the different pairs (src, dst) that are similar."""

    def run(batches):
        for batch in batches:
            ok = [similar(a, b) for a, b in zip(_sets(batch.column(2)), _sets(batch.column(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["src", "dst"]).filter(pa.array(ok, pa.bool_()))

    # the sets stay in their buckets; only those in pairs move
    one = own.join(pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct().hint("merge"), "node", "left_semi")
    one = one.groupBy("node").agg(F.first("shingles").alias("shingles"))
    left = one.select(F.col("node").alias("src"), F.col("shingles").alias("a"))
    right = one.select(F.col("node").alias("dst"), F.col("shingles").alias("b"))
    return pairs.join(left, "src").join(right, "dst").select("src", "dst", "a", "b").mapInArrow(run, "src long, dst long")


def _marks(groups: DataFrame, own: DataFrame) -> DataFrame:
    """node, n, sketch, fine, fp: what the bounds need of the nodes in groups, and their fingerprints."""

    def run(batches):
        for batch in batches:
            found = _sets(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in found], pa.int64()),
                    *(pa.array([f(s) for s in found], pa.binary()) for f in (sketch, fine)),
                    _long([majority([s]) for s in found]),
                ],
                ["node", "n", "sketch", "fine", "fp"],
            )

    some = own.join(groups.select("node").distinct().hint("merge"), "node", "left_semi").select("node", "shingles")
    marked = some.mapInArrow(run, "node long, n long, sketch binary, fine binary, fp long").groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "sketch", "fine", "fp")])
    return common.written(marked, "near-marks")


def _prints(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH // 64)


def close(n: np.ndarray, prints: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the rows i and j pass the bound, which similar sets do."""
    ok = 9 * np.minimum(n[i], n[j]) >= 4 * (n[i] + n[j])
    ok[ok] = 9 * np.bitwise_count(prints[i[ok]] ^ prints[j[ok]]).sum(1, dtype=np.int64) <= (n[i] + n[j])[ok]
    return ok


def first_partners(key: np.ndarray, n: np.ndarray, prints: np.ndarray, new: int = 0):
    """Index pairs: rows from ``new`` on, each with the first row before it, of the WINDOW first of its key, that passes
    the bound. Equal keys stand together."""
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    begin = np.repeat(begin, np.diff(np.concatenate([begin, [len(key)]])))
    at = np.arange(new, len(key))
    for k in range(WINDOW):
        at = at[begin[at] + k < at]
        if not len(at):
            return
        ok = close(n, prints, begin[at] + k, at)
        yield begin[at[ok]] + k, at[ok]
        at = at[~ok]


def dealt(groups: DataFrame, deal: int | None = None) -> DataFrame:
    """cell, node: groups (key, node), those of more than ``deal`` nodes in several cells that have the first nodes of the
    group, WINDOW of them or more, in common. Nodes are hashes, so those under a bound are as many as it says, about."""
    deal = DEAL if deal is None else deal
    large = groups.groupBy("key").agg(F.count(F.lit(1)).alias("of")).where(F.col("of") > deal)
    rows = groups.join(large, "key", "left")
    cells = F.ceil(F.col("of") / deal).cast("int")
    low = F.lit(-(2.0**63)) + F.lit(2.0**64) * F.least(F.lit(1.0), (2 * WINDOW + 64) / F.col("of"))
    own = F.pmod(F.xxhash64("node"), cells).cast("int")
    at = F.when(F.col("of").isNull(), F.array(F.lit(0))).when(F.col("node") <= low, F.sequence(F.lit(0), cells - 1)).otherwise(F.array(own))
    return rows.withColumn("at", F.explode(at)).select(F.when(F.col("of").isNull(), F.col("key")).otherwise(F.xxhash64("key", "at")).alias("cell"), "key", "node")


def print_partners(key: np.ndarray, n: np.ndarray, prints: np.ndarray, fp: np.ndarray, new: int = 0):
    """Index pairs: rows from ``new`` on, each with an earlier row of its key whose fingerprint pivot distance tables find at
    most BITS_APART bits apart and that passes the bound; of several the nearest, then the first."""
    i, j = near_pairs(key, fp, BITS_APART)
    i, j = np.minimum(i, j), np.maximum(i, j)
    some = np.flatnonzero(j >= new)
    some = some[close(n, prints, i[some], j[some])]
    i, j = i[some], j[some]
    order = np.lexsort((i, np.bitwise_count(fp[i] ^ fp[j]), j))
    i, j = i[order], j[order]
    nearest = np.concatenate([[True], j[1:] != j[:-1]])[: len(j)]
    return i[nearest], j[nearest]


def _first(groups: DataFrame, marks: DataFrame) -> DataFrame:
    """src, dst: at most one candidate for each node (src)."""
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        held = None  # the first rows of the last cell
        for batch in batches:
            key, node, size = (batch.column(c).to_numpy() for c in ("cell", "node", "n"))
            prints, fp = _prints(batch.column("sketch")), batch.column("fp").to_numpy().view(np.uint64)
            new = 0
            if held is not None:
                new = len(held[0])
                key, node, size, prints, fp = (np.concatenate(x) for x in zip(held, (key, node, size, prints, fp), strict=True))
            if not len(key):
                continue
            for i, j in (print_partners(key, size, prints, fp, new), *first_partners(key, size, prints, new)):
                bits = np.bitwise_count(fp[i] ^ fp[j]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(node[j]), pa.array(node[i]), pa.array(bits)], ["src", "dst", "bits"])
            begin = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
            held = [x[begin : begin + WINDOW] for x in (key, node, size, prints, fp)]

    rows = dealt(groups).join(marks, "node").select("cell", "node", "n", "sketch", "fp")
    met = rows.repartition(n, "cell").sortWithinPartitions("cell", "node").mapInArrow(run, "src long, dst long, bits int")
    return met.groupBy("src").agg(F.min(F.struct("bits", "dst")).alias("x")).select("src", "x.dst")


def open_pairs(key: np.ndarray, part: np.ndarray, n: np.ndarray, prints: np.ndarray, least: np.ndarray, cell=None, side=None):
    """Index pairs of rows of one cell (by default, one key), in different parts and, where side is given and not 0, on
    different sides, that pass the bound and have no smaller key in common among their least ones. Rows of a cell stand
    together and have one key."""
    cell = key if cell is None else cell
    at = np.arange(len(key))
    for k in range(1, len(key)):
        at = at[at >= k]
        at = at[cell[at - k] == cell[at]]
        if not len(at):
            return
        j = at[part[at - k] != part[at]]
        if side is not None:
            j = j[(side[j] == 0) | (side[j - k] != side[j])]
        j = j[close(n, prints, j - k, j)]
        both = (least[j - k][:, :, None] == least[j][:, None, :]) & (least[j] < key[j][:, None])[:, None, :]
        j = j[~both.any((1, 2))]
        if len(j):
            yield j - k, j


def cells(placed: DataFrame, block: int | None = None) -> DataFrame:
    """cell, side, key, node, part: groups (key, node, part) of up to ``block`` nodes are one cell, larger ones have cells
    of two blocks (sides 1 and 2) or one (side 0). Two nodes of a key in different parts are in one cell together once."""
    block = BLOCK if block is None else block
    size = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("own"))
    large = size.groupBy("key").agg(F.sum("own").alias("of"), F.sum(F.when(F.col("own") <= block, F.col("own")).otherwise(0)).alias("rest")).where(F.col("of") > block)
    large = common.written(large, "near-large", small=True)
    size = common.written(size.join(large, "key").where(F.col("own") > block).select("key", "part", "own"), "near-large", small=True)
    # a block: its key, its component (null: those of few nodes) and a number
    number = lambda c: F.explode(F.sequence(F.lit(0), F.ceil(F.col(c) / block).cast("int") - 1)).alias("no")
    blocks = large.where("rest > 0").select("key", F.lit(None).cast("long").alias("owner"), number("rest"))
    blocks = blocks.unionByName(size.select("key", F.col("part").alias("owner"), number("own"))).withColumn("name", F.xxhash64("key", F.col("owner").isNull(), "owner", "no"))
    a, b = (blocks.select("key", *[F.col(c).alias(c + x) for c in ("owner", "no", "name")]) for x in ("a", "b"))
    met = a.join(b, "key").where("namea < nameb AND NOT (ownera <=> ownerb AND ownera IS NOT NULL) OR namea = nameb AND ownera IS NULL")
    two = F.col("namea") != F.col("nameb")
    cell = F.xxhash64("namea", "nameb").alias("cell")
    sides = met.select(F.col("namea").alias("name"), cell, F.when(two, 1).otherwise(0).alias("side")).unionByName(met.where(two).select(F.col("nameb").alias("name"), cell, F.lit(2).alias("side")))
    small = placed.join(large, "key", "left_anti").select(F.col("key").alias("cell"), F.lit(0).alias("side"), "key", "node", "part")
    rows = placed.join(large, "key").join(size, ["key", "part"], "left")
    owner = F.when(F.col("own").isNotNull(), F.col("part"))
    # few nodes of one component stay together: they are dealt by component
    no = F.pmod(F.when(owner.isNull(), F.xxhash64("part")).otherwise(F.xxhash64("node")), F.ceil(F.coalesce("own", "rest") / block)).cast("int")
    rows = rows.select("key", "node", "part", F.xxhash64("key", owner.isNull(), owner, no).alias("name")).join(sides, "name")
    return small.unionByName(rows.select("cell", "side", "key", "node", "part"))


def _columns(t: pa.Table) -> tuple:
    """What open_pairs takes, of rows with cell, side, key, part, n, sketch and least."""
    cell, side, key, part, size = (t.column(c).to_numpy() for c in ("cell", "side", "key", "part", "n"))
    own = t.column("least").combine_chunks()
    least = np.full((len(key), LEAST_KEYS), np.iinfo(np.int64).max)
    least[np.arange(LEAST_KEYS) < np.diff(own.offsets.to_numpy())[:, None]] = own.flatten().to_numpy()
    return key, part.copy(), size, _prints(t.column("sketch")), least, cell, side


def bounded(t: pa.Table, most: int | None = None):
    """The rows of whole cells; a cell of over ``most`` shingles becomes a cell for each two of its pieces."""
    most = HELD if most is None else most
    cell, n = t.column("cell").to_numpy(), t.column("n").to_numpy()
    edges = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]])) if len(cell) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        piece = np.cumsum(n[a:b]) // (most // 2)
        pieces = np.unique(piece)
        if piece[-1] < 2 or len(pieces) < 2:
            yield t.slice(a, b - a)
            continue
        for x, y in combinations(pieces.tolist(), 2):
            some = t.slice(a, b - a).filter(pa.array((piece == x) | (piece == y)))
            name = mix(cell[a : a + 1].view(np.uint64) + np.array([x], np.uint64) * _SLOT + np.array([y], np.uint64) * _BUCKET)
            yield some.set_column(some.schema.get_field_index("cell"), "cell", _long(np.repeat(name, some.num_rows)))


def links(key, part, n, prints, least, cell, side, own):
    """Index pairs of similar rows, as few as join what open_pairs gives: ``part`` is changed with each, and rows that are
    in one part by then are not compared. own: the set of a row."""
    for i, j in open_pairs(key, part, n, prints, least, cell, side):
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            if part[x] != part[y] and similar(own(x), own(y)):
                part[part == part[y]] = part[x]
                yield x, y


def _open(groups: DataFrame, parts: DataFrame, marks: DataFrame, own: DataFrame) -> DataFrame:
    """src, dst: similar nodes in different components, as many as join these in each cell."""
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = groups.join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"))
    mixed = placed.groupBy("key").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("key")
    placed = common.written(common.few(placed.join(mixed, "key", "left_semi"), groups.count()), "near-open")
    least = placed.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("key")), 1, LEAST_KEYS).alias("least")).join(marks.select("node", "n", "sketch"), "node")

    def met(batches):
        for t in whole_groups(batches, 1):
            some = np.zeros(t.num_rows, bool)
            for i, j in open_pairs(*_columns(t)):
                some[i] = some[j] = True
            for own in bounded(t.filter(pa.array(some))):
                yield from own.to_batches()

    def finer(batches):
        for t in whole_groups(batches, 1):
            prints, size, some = _sets(t.column("fine")), t.column("n").to_numpy(), np.zeros(t.num_rows, bool)
            for i, j in open_pairs(*_columns(t)):
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    if not (some[x] and some[y]) and fine_close(prints[x], prints[y], size[x] + size[y]):
                        some[x] = some[y] = True
            yield from t.drop_columns(["fine"]).filter(pa.array(some)).to_batches()

    def joined(batches):
        for t in whole_groups(batches, 1):
            sets, node = t.column("shingles").combine_chunks(), t.column("node").to_numpy()
            found = list(links(*_columns(t), lambda k, sets=sets: np.frombuffer(sets[k].as_buffer(), np.uint64)))
            i, j = np.array(found, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], ["src", "dst"])

    rows = cells(placed).join(least, "node").select("cell", "side", "key", "node", "part", "n", "sketch", "least")
    rows = rows.repartition(n, "cell").sortWithinPartitions("cell", "node")
    rows = rows.mapInArrow(met, schema := rows.schema).join(marks.select("node", "fine"), "node").select(*rows.columns, "fine")
    rows = common.written(rows.repartition(n, "cell").sortWithinPartitions("cell", "node").mapInArrow(finer, schema), "near-cells")
    # the sets stay in their buckets; only those of rows with a candidate move
    one = own.join(rows.select("node").distinct().hint("merge"), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))
    whole = rows.join(one, "node").select(*rows.columns, "shingles").repartition(n, "cell").sortWithinPartitions("cell", "node")
    # a cell has fewer links than rows
    out = common.written(common.few(whole.mapInArrow(joined, "src long, dst long").distinct(), rows.count()), "near-edges")
    common.drop_written(placed)
    common.drop_written(rows)
    return out


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, root of each row of ``docs`` (doc_id, text): near-copies have equal roots."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = common.bucketed(sets(docs).repartition(n, "node"), "node", "near-sets")
    own = made.where("shingles IS NOT NULL").select("node", "shingles")
    common.release(docs.sparkSession)  # the sets' shuffle, then the keys': held until here by the plans above
    groups = _groups(own)
    common.release(docs.sparkSession)
    marks = _marks(groups, own)
    first = common.written(common.few(_first(groups, marks), groups.count()), "near-pairs")
    edges = common.written(_verified(first, own), "near-edges")
    more = _open(groups, connected_components(common.few(edges, edges.count())), marks, own)
    both = edges.unionByName(more)
    roots = connected_components(common.few(both, both.count()))
    texts = made.groupBy("text_hash").agg(F.min("node").alias("node")).join(roots, "node", "left").select("text_hash", F.coalesce("component", "node").alias("root"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash")).join(texts, "text_hash")
    rows = common.written(rows.select("doc_id", "text_hash", "root"), "near-rows")
    for table in (made, groups, marks, first, edges, more):
        common.drop_written(table)
    return rows


def first_rows(rows: DataFrame) -> DataFrame:
    """doc_id, text_hash: of each root the row with the smallest id, and of its rows with that id one with the smallest
    text hash. A text has one root, so this pair tells a kept row without a look at its root."""
    least = rows.where("doc_id IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"))
    return least.select("least.*")
