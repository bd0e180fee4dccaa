"""Embedding near-duplicates: random-hyperplane sign hashing, exact cosine verification, connected components.

Equal vectors of a label are one class first (by 128 bits of hash, computed by Spark), so a vector that is everywhere is
hashed once. Each class gets ``tables`` signatures of ``planes`` signs. Both follow the data: planes grow with the
logarithm of the largest label, so that vectors that are not alike rarely meet, and tables so that two vectors at the
limit meet nowhere with a probability of MISS at most; the more similar, the surer.

Ids go first: (bucket, class) rows show which buckets have two classes or more, and of buckets with the same classes in
several tables only the first is kept, as it shows the same pairs. Only then vectors are sent to what is left. A bucket
over BUCKET_ROWS is dealt into blocks, and pairs of blocks meet in cells, so every pair of a large bucket is still
compared, in many tasks. Pairs are verified with cosines in double precision. A pair that meets in several tables is
counted in the first one, which both sides can tell from their signatures. Only link counts and edges of spanning forests
leave a task.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows with a null label or id,
link with nothing; vectors of different lengths do not link; equal rows are copies of each other and link; a row without
links is its own component; for a null id component_id is null and kept is true; rows with one id and different vectors
are one node of the graph; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .graph import connected_components, local_roots, whole_groups

LEAST_COSINE = 0.98
SEED, MISS = 11, 1e-3
#: Planes beyond the logarithm of a label's classes, and the most of them.
MORE_PLANES, MOST_PLANES = 6, 30
BUCKET_ROWS = 256
#: Cosines of products of normalised vectors are a little off; pairs this near to the limit are computed again.
SLACK = 1e-9


def plan(classes: int, miss: float = MISS) -> tuple[int, int]:
    """(tables, planes) for labels of at most so many classes."""
    planes = min(MOST_PLANES, max(1, math.ceil(math.log2(max(1, classes)))) + MORE_PLANES)
    meet = (1 - math.acos(LEAST_COSINE) / math.pi) ** planes
    return math.ceil(math.log(miss) / math.log(1 - meet)), planes


def signatures(x: np.ndarray, tables: int, planes: int) -> np.ndarray:
    """[vector, table] -> signs as bits of a number."""
    normal = np.random.default_rng([SEED, x.shape[1]]).standard_normal((x.shape[1], tables * planes))
    out = np.empty((len(x), tables), np.int32)
    for a in range(0, len(x), 4096):
        signs = (x[a : a + 4096] @ normal > 0).reshape(-1, tables, planes)
        out[a : a + 4096] = signs @ (1 << np.arange(planes))
    return out


def _exact(x: np.ndarray, norm: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for a in range(0, len(i), 1 << 15):
        s = slice(a, a + (1 << 15))
        out[s] = np.einsum("ij,ij->i", x[i[s]], x[j[s]]) / (norm[i[s]] * norm[j[s]])
    return out


def cell_pairs(cell: np.ndarray, side: np.ndarray, mixed: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked rows in each cell; in mixed cells only pairs of different sides. Rows are sorted by cell."""
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    begins = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    size = np.diff(np.concatenate([begins, [len(cell)]]))
    left, right = [], []
    small = np.repeat(size <= 48, size)
    alive, k = np.flatnonzero(small), 0
    while len(alive):
        k += 1
        alive = alive[alive + k < len(cell)]
        alive = alive[cell[alive] == cell[alive + k]]
        left.append(alive)
        right.append(alive + k)
    u = None
    for b, n in zip(begins[size > 48], size[size > 48], strict=True):
        if u is None:
            u = x / norm[:, None]
        for r in range(b, b + n, 512):
            c = u[r : min(r + 512, b + n)] @ u[r : b + n].T
            i, j = np.nonzero(c >= LEAST_COSINE - SLACK)
            up = j > i
            left.append(i[up] + r)
            right.append(j[up] + r)
    i, j = (np.concatenate(y) if y else np.zeros(0, np.int64) for y in (left, right))
    ok = ~mixed[i] | (side[i] != side[j])
    i, j = i[ok], j[ok]
    ok = _exact(x, norm, i, j) >= LEAST_COSINE
    return i[ok], j[ok]


def keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v and the two hashes of v, which are null where it can link with nothing."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), F.col("embedding").cast("array<float>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    able = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & ~F.forall("v", lambda c: c == 0)
    return rows.withColumns({"d1": F.when(able, F.xxhash64("v")), "d2": F.when(able, F.xxhash64(F.lit(SEED), "v"))})


def classes(rows: DataFrame) -> DataFrame:
    """label, d1, d2, dim, v, rep (smallest id), m (rows) of each class of equal vectors that can link. Partial sums before
    the shuffle, so a very common vector moves once a task."""
    return (
        rows.where("d1 IS NOT NULL AND d2 IS NOT NULL")
        .groupBy("label", "d1", "d2")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"), F.first("v").alias("v"))
        .withColumn("dim", F.size("v"))
    )


def buckets(own: DataFrame, tables: int, planes: int) -> DataFrame:
    """key, t, rep, n: the classes of each bucket that has n of them, two or more; a written table of ids."""

    def sign(batches):
        for batch in batches:
            lists = batch.column("v")
            lens = lists.value_lengths().to_numpy()
            sig = np.zeros((len(lens), tables), np.int32)
            for d in np.unique(lens):
                at = np.flatnonzero(lens == d)
                sig[at] = signatures(lists.take(pa.array(at)).flatten().to_numpy().reshape(len(at), d).astype(np.float64), tables, planes)
            offsets = pa.array(np.arange(len(lens) + 1, dtype=np.int32) * tables)
            kept = [batch.column(c) for c in ("label", "dim", "rep")]
            yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(offsets, pa.array(sig.reshape(-1)))], ["label", "dim", "rep", "sig"])

    signed = own.select("label", "dim", "rep", "v").mapInArrow(sign, "label int, dim int, rep long, sig array<int>")
    rows = signed.select("*", F.posexplode("sig").alias("t", "s")).select(F.xxhash64("label", "dim", "t", "s").alias("key"), "t", "rep")
    several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return common.written(rows.join(several.hint("merge"), "key"), "vector-buckets")


def different_sets(met: DataFrame) -> DataFrame:
    """Of buckets with the same classes the one of the first table."""
    own = met.groupBy("key").agg(
        F.min("t").alias("t"), F.max("n").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64(F.lit(SEED), "rep")).alias("y")
    )
    first = own.groupBy("n", "x", "y").agg(F.min(F.struct("t", "key")).alias("k")).select(F.col("k.key").alias("key"))
    return met.join(first, "key")


def near_vectors(own: DataFrame, bucket_rows: int = BUCKET_ROWS, miss: float = MISS) -> DataFrame:
    """rep, links, root: in every cell, linked rows of other classes and a representative of the linked ones."""
    spark = own.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = own.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).head()[0] or 0
    tables, planes = plan(most, miss)
    met = buckets(own, tables, planes)
    blocks = F.ceil(F.col("n") / bucket_rows).cast("int")
    dealt = (
        different_sets(met)
        .withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("cell", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
        .select("cell", "t", "block", (F.col("block") != F.col("other")).alias("moved"), "rep")
        .join(own.select("rep", "label", "dim", "m", "v"), "rep")
    )

    def compare(batches):
        for t in whole_groups(batches, 1):
            dims = t.column("dim").to_numpy()
            for d in np.unique(dims):
                part = t.filter(pa.array(dims == d)).combine_chunks()
                cell, block = part.column("cell").to_numpy(), part.column("block").to_numpy()
                x = part.column("v").combine_chunks().flatten().to_numpy().reshape(-1, d).astype(np.float64)
                sig = signatures(x, tables, planes)
                table, rep, m = (part.column(c).to_numpy() for c in ("t", "rep", "m"))
                # a cell of two blocks has rows of both; a row of the cell (b, b) has not moved
                mixed = part.column("moved").to_numpy(zero_copy_only=False)
                i, j = cell_pairs(cell, block, mixed, x)
                label = part.column("label").to_numpy()
                at = np.arange(len(rep))
                met = sig[at, table]  # cells are told apart by a hash; were two to share one, their rows still don't link
                ok = (label[i] == label[j]) & (table[i] == table[j]) & (met[i] == met[j])
                i, j = i[ok], j[ok]
                earlier = (sig[i] == sig[j]) & (np.arange(tables)[None, :] < table[i][:, None])
                first = ~earlier.any(1)
                links = np.zeros(len(rep), np.int64)
                np.add.at(links, i[first], m[j[first]])
                np.add.at(links, j[first], m[i[first]])
                order = np.argsort(rep, kind="stable")  # the root of a forest is its smallest id
                place = np.empty(len(rep), np.int64)
                place[order] = np.arange(len(rep))
                root = rep[order][local_roots(len(rep), place[i], place[j])][place]
                told = np.flatnonzero((links > 0) | (root != rep))
                yield pa.RecordBatch.from_arrays([pa.array(rep[told]), pa.array(links[told]), pa.array(root[told])], ["rep", "links", "root"])

    found = dealt.repartition(n, "cell").sortWithinPartitions("cell").select("cell", "t", "block", "moved", "label", "dim", "rep", "m", "v")
    return common.written(found.mapInArrow(compare, "rep long, links long, root long"), "vector-links")


def near_duplicates(vectors: DataFrame, bucket_rows: int = BUCKET_ROWS, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding, label)."""
    common.tune(vectors.sparkSession)
    rows = keyed(vectors)
    own = common.written(classes(rows), "vector-classes")
    found = near_vectors(own, bucket_rows, miss)
    roots = connected_components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    told = (
        own.select("label", "d1", "d2", "rep", "m")
        .join(links, "rep", "left")
        .join(roots, F.col("rep") == F.col("node"), "left")
        .select("label", "d1", "d2", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("root"))
    )
    out = rows.select("vec_id", "label", "d1", "d2").join(told, ["label", "d1", "d2"], "left").select(
        "vec_id",
        F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("root", "vec_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_embedding_dedup(spark, sf_dir):
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))


#: Every pair, so only for small tables.
OP9_SQL = f"""
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda c: abs(c))) > 0)
  , n AS (SELECT *, sqrt(list_dot_product(v, v)) AS norm FROM e)
  , l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= {LEAST_COSINE}::DOUBLE)
  , r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
  , c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
  , k AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT vec_id, coalesce(links, 0) AS n_links, coalesce(least(low, vec_id), vec_id) AS component_id,
  vec_id = coalesce(least(low, vec_id), vec_id) AS kept
FROM embeddings LEFT JOIN k ON vec_id = k.a LEFT JOIN c ON vec_id = c.a
"""
