"""SimHash near-duplicates with pivot distance tables.

A fingerprint bit is set if it is set in over half the XXH64 hashes of a text's word shingles. Fingerprints that differ
in at most two of 64 bits agree in two of four 16-bit blocks, so distinct fingerprints meet in six tables by the 32 bits
of two blocks. Inside a group, a table of Hamming distances to PIVOTS reference fingerprints discards every pair whose
distances to any pivot differ by more than two (triangle inequality), and the survivors are verified.

The fingerprints of groups over GROUP_ROWS meet in smaller ones instead: those within two bits agree in six of eight
8-bit blocks, so in one of 28 tables by the 48 bits of six blocks. These groups, in which at most 16 bits differ, go through
the same distance tables.

Only edges of spanning forests leave a task. Components come from the distributed graph step.

Defined results: a null, empty or wordless text has fingerprint zero and links like any other; fewer words than a shingle
make one shingle; repeated rows share a component; rows with a null id take part, but do not name a component unless
there is no other id, and then it is null; ids are whole numbers (of another type: cast to long, an error if they are not);
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .graph import connected_components, local_roots, whole_groups

WORDS, BITS_APART, SEED = 3, 2, 42
PIVOTS, GROUP_ROWS = 16, 512
BLOCK_BYTES = 1 << 20


def _pieces(text: bytes):
    """The text in pieces that end between words."""
    at = 0
    while len(text) - at > BLOCK_BYTES:
        end = at + BLOCK_BYTES
        while end < len(text) and text[end : end + 1].strip():
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def shingle_hashes(text: bytes | None, words: int):
    """Arrays of the hashes of the UTF-8 text's shingles, in order; fewer words than a shingle make one."""
    from xxhash import xxh64_intdigest

    held, some = [], False
    for piece in _pieces(text or b""):
        held += piece.lower().split()
        if len(held) < words:
            continue
        lens = np.fromiter(map(len, held), np.int64, len(held)) + 1
        ends = np.cumsum(lens) - 1
        begins = (ends + 1 - lens)[: len(held) - words + 1].tolist()
        line = b" ".join(held)
        shingles = [line[a:b] for a, b in zip(begins, ends[words - 1 :].tolist(), strict=True)]
        yield np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
        some = True
        held = held[len(held) - words + 1 :] if words > 1 else []
    if held and not some:
        yield np.array([xxh64_intdigest(b" ".join(held), SEED)], np.uint64)


def majority(parts) -> int:
    """The bits set in over half of the hashes in the arrays ``parts``, as an unsigned number."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        for i in range(0, len(hashes), 1 << 16):
            bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """Of the UTF-8 text, as an unsigned number."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""
    common.tune(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def near_pairs(group: np.ndarray, fp: np.ndarray, apart: int = BITS_APART) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of one group whose fingerprints differ in at most ``apart`` bits."""
    table = np.bitwise_count(fp[:, None] ^ pivots()[None, :]).astype(np.int8)
    order = np.lexsort((table[:, 0], group))
    group, fp, table = group[order], fp[order], table[order]
    left, right, alive, k = [], [], np.arange(len(fp)), 0
    while len(alive):
        k += 1
        alive = alive[alive + k < len(fp)]
        # sorted by the first distance: a row past the limit has nothing after it
        alive = alive[(group[alive] == group[alive + k]) & (table[alive + k, 0] - table[alive, 0] <= apart)]
        found = alive[np.abs(table[alive] - table[alive + k]).max(1, initial=0) <= apart]
        found = found[np.bitwise_count(fp[found] ^ fp[found + k]) <= apart]
        left.append(order[found])
        right.append(order[found + k])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def near_edges(fps: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """src, dst: edges that join all distinct fingerprints (column fp) at most two bits apart."""
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = lambda i: F.shiftright("fp", 16 * i).bitwiseAND(0xFFFF)
    keys = F.array(*[(F.shiftleft(block(a), 16) + block(b)) * 6 + k for k, (a, b) in enumerate(combinations(range(4), 2))])
    rows = fps.select(F.explode(keys).alias("key"), "fp")
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows).select("key")

    def run(batches):
        for t in whole_groups(batches, 1):
            fp = t.column("fp").to_numpy().view(np.uint64)
            i, j = near_pairs(t.column("key").to_numpy(), fp)
            at, where = np.unique(fp, return_inverse=True)
            root = local_roots(len(at), where[i], where[j])
            move = np.flatnonzero(root != np.arange(len(at)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[move].view(np.int64)), pa.array(at[root[move]].view(np.int64))], ["src", "dst"]
            )

    # of eight blocks of 8 bits, two fingerprints at most two bits apart share six
    masks = [sum(0xFF << 8 * b for b in kept) for kept in combinations(range(8), 6)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    finer = F.explode(F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for k, m in enumerate(signed)]))
    listed = rows.join(large, "key", "left_semi").select("fp").distinct().select(finer.alias("key"), "fp")
    met = rows.join(large, "key", "left_anti").unionByName(listed)
    return met.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "src long, dst long")


def near_components(docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, fingerprint, component_id of each row of ``docs`` (doc_id, text)."""
    marked = common.written(fingerprints(docs), "simhash")
    fps = marked.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = connected_components(near_edges(marked.select("fp").distinct(), group_rows))
    placed = fps.join(roots, fps.fp == roots.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    names = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = placed.join(names, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash(spark, sf_dir):
    return near_components(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage_simhash(spark, docs, sf_dir):
    """One document of each component of near-copies (five-word shingles, similarity 0.8 or more; near_sets pairs them by
    their fingerprints in pivot distance tables and finds the rest exactly): that with the smallest id, once. Documents are told apart by id and text: of two different texts with one id neither goes
    because the other is a copy. Rows without an id stay."""
    from .near_sets import first_rows, near_copies, text_hash

    own_id, own_hash = common.OWN + "id", common.OWN + "hash"
    keep = first_rows(near_copies(docs)).select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash))
    marked = docs.withColumn(common.OWN + "text", text_hash())
    rest = marked.where("doc_id IS NOT NULL").join(keep, (F.col("doc_id").cast("long") == F.col(own_id)) & (F.col(common.OWN + "text") == F.col(own_hash)), "left_semi")
    once = rest.dropDuplicates(["doc_id", common.OWN + "text"])
    return once.unionByName(marked.where("doc_id IS NULL")).select(*docs.columns)
