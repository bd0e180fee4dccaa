"""Importance resampling of documents towards a target distribution of hashed word runs.

Every run of 1 to n words is a feature that falls into one of ``BUCKETS`` buckets by its crc32. How often a bucket occurs
in the target against the corpus gives its gain; a document's weight is the mean gain of its features, and the documents
with the highest weight plus Gumbel noise of their ids are drawn, which samples without replacement by weight.

Skewed long texts are cut into overlapping chunks at word boundaries: a chunk owns the places where its features begin and
carries the n - 1 words after them, so that no feature is lost or counted twice. Short texts are counted where they are
read; only chunks of longer ones are dealt out to all tasks, and the sums of chunks are added by document. Counts leave a
task as one row for each bucket. Ranks come from counts by score, added from the top, and an order within each score:
no task sorts the whole corpus.

Words are runs of ASCII digits, letters and characters beyond ASCII, with A-Z lowered. Defined results: a null text has no
words; a document without features has weight 0; a null id is hashed as an empty one and comes first among ties; repeated
rows are documents of their own and get consecutive ranks; equal ids with equal scores are ranked by n_features; with an
empty target or corpus the gains follow from zero counts; an empty table gives no rows; columns other than the id and the
text are ignored. A word has to fit a task.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

RUN, BUCKETS, SEED = 1, 10_000, "2024"
MIN_WORDS, PERCENT = 20, 10
#: Bytes of a chunk; texts up to this are not cut.
CHUNK = 65_536
#: Bytes of texts handled at once in numpy.
BATCH_BYTES = 1_000_000
#: Words longer than this are hashed one at a time.
LONG_WORD = 48

_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def _extended(crc: np.ndarray, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The crc registers ``crc`` after the bytes of one word each."""
    order = np.argsort(-lens, kind="stable")
    c, s, n = crc[order], starts[order], lens[order]
    longer = int(np.searchsorted(-n, -LONG_WORD))
    for i in range(longer):
        word = data[s[i] : s[i] + n[i]].tobytes()
        c[i] = zlib.crc32(word, int(c[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    c, s, n, head = c[longer:], s[longer:], n[longer:], c[:longer]
    for k in range(int(n[0]) if len(n) else 0):
        m = int(np.searchsorted(-n, -k))  # words with a byte at k
        c[:m] = _CRC[(c[:m] ^ data[s[:m] + k]) & 0xFF] ^ (c[:m] >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = np.concatenate([head, c])
    return out


def features(texts: list[bytes], owned: list[int] | None, n: int = RUN, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts in UTF-8: the words each owns, the features that begin at these, and the features' buckets, text by text
    within each length of run. owned: how many first words a text owns, -1 for all."""
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)  # lowers A-Z alone
    ends = np.cumsum([len(t) + 1 for t in texts])
    inside = _IS_WORD[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside])))
    starts, lens = edge[::2], edge[1::2] - edge[::2]
    doc = np.searchsorted(ends, starts, "right")
    words = np.bincount(doc, minlength=len(texts))
    own = words if owned is None else np.where(np.array(owned) < 0, words, np.minimum(owned, words))
    place = np.arange(len(starts)) - np.repeat(np.cumsum(words) - words, words)
    mine = place < own[doc]
    per, found, of = np.zeros(len(texts), np.int64), [], []
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    for k in range(min(n, len(starts))):
        if k:
            crc = crc[: len(starts) - k]
            crc = _CRC[(crc ^ np.uint32(0x20)) & 0xFF] ^ (crc >> np.uint32(8))
        crc = _extended(crc, data, starts[k:], lens[k:])
        at = np.flatnonzero(mine[: len(crc)] & (doc[: len(crc)] == doc[k:]))
        found.append((crc[at] ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets))
        of.append(doc[at])
        per += np.bincount(of[-1], minlength=len(texts))
    return own, per, (np.concatenate(of), np.concatenate(found).astype(np.int64)) if found else (np.zeros(0, np.int64),) * 2


def chunks(text: bytes, n: int = RUN, most: int = CHUNK):
    """(chunk, words owned): the words of ``text`` in order, about ``most`` bytes of them owned by each chunk, and the
    n - 1 words after these. A word is never cut."""
    begin, lower = 0, text.lower()
    while begin < len(text):
        end = begin + most
        while end < len(text) and _IS_WORD[lower[end]]:
            end += 1
        end = carry = min(end, len(text))
        for _ in range(n - 1):
            while carry < len(text) and not _IS_WORD[lower[carry]]:
                carry += 1
            while carry < len(text) and _IS_WORD[lower[carry]]:
                carry += 1
        flags = _IS_WORD[np.frombuffer(lower[begin:end], np.uint8)]
        yield text[begin:carry], int(flags[0]) + int((flags[1:] & ~flags[:-1]).sum())
        begin = end


def _whole(batch, column: str) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def _groups(sizes):
    return common.cut(sizes, BATCH_BYTES)


def bucket_counts(docs: DataFrame, text: str = "text", n: int = RUN, buckets: int = BUCKETS, most: int = CHUNK) -> DataFrame:
    """bucket, n: how often features fall into each bucket that has any. Chunks of long texts are dealt out."""
    common.tune(docs.sparkSession)

    def counted(texts, owned, total):
        for i, j in _groups(map(len, texts)):
            total += np.bincount(features(texts[i:j], owned and owned[i:j], n, buckets)[2][1], minlength=buckets)

    one = lambda v, t: pa.array([v], t)

    def read(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = _whole(batch, text)
            counted([t for t in texts if len(t) <= most], None, total)
            for t in texts:
                if len(t) > most:
                    for chunk, own in chunks(t, n, most):
                        yield pa.RecordBatch.from_arrays([one(None, pa.binary()), one(chunk, pa.binary()), one(own, pa.int64())], ["counts", "chunk", "own"])
        yield pa.RecordBatch.from_arrays([one(total.tobytes(), pa.binary()), one(None, pa.binary()), one(None, pa.int64())], ["counts", "chunk", "own"])

    def rest(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for done in batch.column("counts").drop_null():
                total += np.frombuffer(done.as_py(), np.int64)
            part = batch.filter(batch.column("chunk").is_valid())
            counted(_whole(part, "chunk"), part.column("own").to_pylist(), total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    dealt = docs.select(text).mapInArrow(read, "counts binary, chunk binary, own long").repartition(_tasks(docs))
    return dealt.mapInArrow(rest, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _tasks(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket. Two tables of at most ``buckets`` rows come to the driver."""
    found = np.zeros((2, buckets), np.int64)
    for k, counts in enumerate((corpus, target)):
        for r in counts.collect():
            found[k, r["bucket"]] = r["n"]
    s, t = found.tolist()
    ss, tt = sum(s) + buckets, sum(t) + buckets
    return np.array([math.floor(1000 * math.log((t[b] + 1.0) * ss / ((s[b] + 1.0) * tt))) for b in range(buckets)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text: str = "text", n: int = RUN, most: int = CHUNK) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row of ``docs``."""
    buckets = len(gain)
    names, schema = ["id", "row", "words", "n", "gain", "chunk", "own"], f"id {docs.schema[id_col].dataType.simpleString()}, row long, words long, n long, gain long, chunk binary, own long"

    def sums(texts, owned):
        words, per, total = [], [], []
        for i, j in _groups(map(len, texts)):
            own, count, (of, bucket) = features(texts[i:j], owned and owned[i:j], n, buckets)
            g = np.zeros(j - i, np.int64)
            np.add.at(g, of, gain[bucket])
            words.append(own)
            per.append(count)
            total.append(g)
        return [pa.array(np.concatenate(x).astype(np.int64)) if x else pa.nulls(0, pa.int64()) for x in (words, per, total)]

    def read(batches):
        for batch in batches:
            texts = _whole(batch, "text")
            short = np.array([len(t) <= most for t in texts], bool)
            at = pa.array(np.flatnonzero(short))
            part = batch.select(["id", "row"]).take(at)
            none = pa.nulls(len(at))
            yield pa.RecordBatch.from_arrays([*part.columns, *sums([t for t in texts if len(t) <= most], None), none.cast(pa.binary()), none.cast(pa.int64())], names)
            for k in np.flatnonzero(~short):
                one, zero = batch.select(["id", "row"]).slice(k, 1).columns, pa.nulls(1, pa.int64())
                for chunk, own in chunks(texts[k], n, most):
                    yield pa.RecordBatch.from_arrays([*one, zero, zero, zero, pa.array([chunk]), pa.array([own])], names)

    def rest(batches):
        for batch in batches:
            at = pa.array(np.flatnonzero(np.array(batch.column("chunk").is_valid())))
            part, done = batch.take(at), batch.filter(batch.column("chunk").is_null())
            yield pa.RecordBatch.from_arrays(done.columns[:5], names[:5])
            if len(at):
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *sums(_whole(part, "chunk"), part.column("own").to_pylist())], names[:5])

    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    parts = rows.mapInArrow(read, schema).repartition(_tasks(docs)).mapInArrow(rest, schema.split(", chunk")[0])
    total = parts.groupBy("row").agg(F.first("id").alias(id_col), *(F.sum(c).alias(c) for c in ("words", "n", "gain")))
    mean = F.expr("CASE WHEN n = 0 THEN 0 ELSE (gain - pmod(gain, n)) DIV n END")
    return total.select(id_col, F.col("words").alias("n_words"), F.col("n").alias("n_features"), mean.alias("weight"))


def drawn(docs: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: str = SEED, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``weighted`` with their score, and the rank of those that are drawn."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = common.written(docs.withColumn("score", F.col("weight") + noise), "scored")
    can = F.col("n_words") >= min_words
    # counts by score, as few rows as there are scores; added from the top in two steps, so that no window has them all
    by_score = common.written(scored.where(can).groupBy("score").agg(F.count("*").alias("n")), "scores", small=True).withColumn("block", F.floor(F.col("score") / 256))
    blocks = by_score.groupBy("block").agg(F.sum("n").alias("n"))
    down = Window.orderBy(F.desc("block"))
    blocks = blocks.select("block", (F.sum("n").over(down) - F.col("n")).alias("before"), F.expr("sum(n) OVER ()").alias("all"))
    within = Window.partitionBy("block").orderBy(F.desc("score"))
    before = by_score.join(blocks, "block").select("score", F.lit(True).alias("can"), (F.col("before") + F.sum("n").over(within) - F.col("n")).alias("before"), F.expr(f"(all * {int(percent)}) DIV 100").alias("most"))
    ranked = scored.withColumn("can", can).join(before.where("before < most"), ["score", "can"], "left")
    order = Window.partitionBy("score", "can").orderBy(F.asc_nulls_first(id_col), "n_features", "weight")
    rank = F.col("before") + F.row_number().over(order)
    return ranked.withColumn("rank", rank).select(id_col, "n_features", "weight", "score", F.when(F.col("rank") <= F.col("most"), F.col("rank")).cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = RUN, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: str = SEED, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every row of ``docs``; target has a column of
    the same name as ``text``."""
    gain = gains(bucket_counts(docs, text, n, buckets, chunk), bucket_counts(target, text, n, buckets, chunk), buckets)
    return drawn(weighted(docs, gain, id_col, text, n, chunk), percent, min_words, seed, id_col)


def op12_importance(spark, sf_dir):
    return resample(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"))


_WORDS = r"""unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))"""
_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
OP12_SQL = rf"""
WITH RECURSIVE steps(i, k, c) AS (SELECT i, 0, i FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, k + 1, {_STEP} FROM steps WHERE k < 8)
  , crc AS (SELECT list(c ORDER BY i) AS tab FROM steps WHERE k = 8)
  , doc_words AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, {_WORDS} AS w FROM documents) GROUP BY ALL)
  , bench_words AS (SELECT w, count(*) AS n FROM (SELECT {_WORDS} AS w FROM benchmark) GROUP BY ALL)
  , words AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM doc_words UNION SELECT w FROM bench_words))
  , bytes AS (SELECT w, [CAST('0x' || x[2 * j + 1:2 * j + 2] AS BIGINT) FOR j IN range(len(x) // 2)] AS b FROM words)
  , hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda c, y: xor(c >> 8, tab[xor(c & 255, y) + 1])), 4294967295) % {BUCKETS} AS bucket FROM bytes, crc)
  , s AS (SELECT bucket, sum(n) AS s FROM doc_words JOIN hashed USING (w) GROUP BY 1)
  , t AS (SELECT bucket, sum(n) AS t FROM bench_words JOIN hashed USING (w) GROUP BY 1)
  , totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM doc_words)::DOUBLE + {BUCKETS} AS ss, (SELECT coalesce(sum(n), 0) FROM bench_words)::DOUBLE + {BUCKETS} AS tt)
  , gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ss / ((s::DOUBLE + 1) * tt))) AS BIGINT) AS g FROM s LEFT JOIN t USING (bucket), totals)
  , per AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * g) AS BIGINT) AS total FROM doc_words JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY doc_id)
  , scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, CAST(coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS BIGINT) AS weight,
      CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT)::DOUBLE AS h FROM documents LEFT JOIN per USING (doc_id))
  , final AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {MIN_WORDS} AND r <= {PERCENT} * sum(CASE WHEN n_features >= {MIN_WORDS} THEN 1 ELSE 0 END) OVER () // 100 THEN r END AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id) AS r FROM final)
"""
