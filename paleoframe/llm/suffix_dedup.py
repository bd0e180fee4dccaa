"""Exact substring dedup: remove every byte inside a LENGTH-byte string that starts earlier in the corpus.

"Earlier" is a smaller document id, or the same document and a smaller start. Matches never cross documents.

1. Texts that are equal as a whole are one text from here on; all but the one with the smallest id go entirely.
2. Every window of LENGTH bytes has an anchor: the leftmost of its ANCHOR-byte strings with the smallest hash. Equal
   windows have equal anchors at equal places, so only windows whose anchor occurs twice or more can repeat. Anchors are
   counted by a grouped sum; about three in a hundred places are anchors.
3. Consecutive windows with one anchor are one context. Equal contexts are merged to their earliest owner (partial minima
   before the shuffle). Contexts are gathered by anchor and laid end to end in blocks of BLOCK_BYTES; a block's suffix
   array (two-stage sorting) and the common prefixes of neighbours show which windows are equal, and of each set of equal
   ones the earliest is noted as a first occurrence.
4. An anchor with over GROUP_CONTEXTS different contexts is not gathered at once. Its windows are parted by how far the
   anchor lies from their begin, in halves, and contexts meet by all bytes beside the anchor that the windows of a half
   have in common; halves that are still too large are parted again. A part of one place has whole windows for its key,
   and equal ones are merged, so no block is larger, however common a string is.
5. Back at its document, every window with a repeated anchor that is no first occurrence is a repeat.

All steps are exact, every first occurrence comes from a block's suffix array, and none depends on how large a group is; a
single text is held whole by one task.

Defined results: a null text is empty; texts under LENGTH bytes are untouched; a null id is smaller than all others;
repeated rows (same id and text) have the same result, that of one of them; rows with the same id and different texts
count as one owner, so that what both begin with at the same place is kept in both; ids are whole numbers (of another
type: cast to long, an error if they are not); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .graph import whole_groups
from .suffixes import common_prefixes, suffix_array

LENGTH, ANCHOR = 100, 32
GROUP_CONTEXTS = 1024
#: Halvings after which a part is one window.
STEPS = (LENGTH - ANCHOR).bit_length()
#: A text that is there very often is met by so many tasks.
SALTS = 16
BLOCK_BYTES = 1 << 18
CHUNK_BYTES = 1 << 20
NO_ID = -(1 << 63)
_PLACE_BITS = np.uint64(24)
_M1, _M2, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), 0x100000001B3


def _hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ANCHOR bytes from each place on, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _M1
    h ^= h >> np.uint64(32)
    have, power = 1, _B
    while have < ANCHOR:
        h = h[:-have] * np.uint64(power) + h[have:]
        power = power * power % (1 << 64)
        have *= 2
    h = (h ^ (h >> np.uint64(31))) * _M2
    return h ^ (h >> np.uint64(29))


def contexts(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: document, first window, last window, anchor (places in data), anchor hash.

    data: texts end to end, under 2 ** 24 bytes; ends: where each ends.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, np.zeros(0, np.uint64)
    h = _hashes(data)
    low = (h >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
    wide, have = LENGTH - ANCHOR + 1, 1
    while have * 2 <= wide:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if wide > have:
        low = np.minimum(low[: len(low) - (wide - have)], low[wide - have :])
    anchor = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    count = np.maximum(ends - begins - LENGTH + 1, 0)  # windows of each text
    doc = np.repeat(np.arange(len(ends)), count)
    window = np.arange(len(doc)) + np.repeat(begins - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    if not len(window):
        return none, none, none, none, np.zeros(0, np.uint64)
    anchor = anchor[window]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(window)]]) - 1
    return doc[first], window[first], window[last], anchor[first], h[anchor[first]]


def _segments(texts: list[bytes]):
    """Texts in lots of CHUNK_BYTES: (index of the first, data, ends, offset). A longer text comes in parts, whose
    windows continue each other; offset is the part's place in its text."""
    most = max(CHUNK_BYTES, 2 * LENGTH)
    for i, j in common.cut(map(len, texts), most):
        if j == i + 1 and len(texts[i]) > most:
            for at in range(0, len(texts[i]) - LENGTH + 1, most):
                part = np.frombuffer(texts[i], np.uint8)[at : at + most + LENGTH - 1]
                yield i, part, np.array([len(part)]), at
        else:
            yield i, np.frombuffer(b"".join(texts[i:j]), np.uint8), np.cumsum([len(t) for t in texts[i:j]]), 0


def text_contexts(texts: list[bytes]):
    """Over all texts: lots of (text number, first window, last window, anchor (places in the text), anchor hash)."""
    for i, data, ends, offset in _segments(texts):
        doc, a, b, p, h = contexts(data, ends)
        begin = np.concatenate([[0], ends[:-1]])[doc]
        yield doc + i, a - begin + offset, b - begin + offset, p - begin + offset, h


def first_windows(texts: list[bytes], doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all LENGTH-byte windows of the contexts ``texts``, which begin at ``at`` of documents ``doc``: the earliest of
    each set of equal ones, as (document, start)."""
    line = b"\xff".join(texts)  # a byte that is in no UTF-8 text
    data = np.frombuffer(line, np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    order = suffix_array(data, LENGTH)
    of = np.searchsorted(begins, order, "right") - 1
    inside = order - begins[of]
    ok = inside + LENGTH <= sizes[of]
    order, of, inside = order[ok], of[ok], inside[ok]
    group = np.cumsum(common_prefixes(data, order, LENGTH) < LENGTH)
    owner, start = doc[of], at[of] + inside
    rank = np.lexsort((start, owner, group))
    g = group[rank]
    best = rank[np.concatenate([[True], g[1:] != g[:-1]])]
    return owner[best], start[best]


def _runs(doc: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)]))
    size = np.diff(np.concatenate([new, [len(doc)]]))
    return pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.array(start[new]), pa.array(size)], ["doc", "start", "size"])


def _anchors(texts: DataFrame) -> DataFrame:
    """doc, anchors: the texts with repeated anchors."""

    def run(batches):
        for batch in batches:
            docs = batch.column(0).to_numpy()
            for doc, _, _, _, h in text_contexts(batch.column(1).to_pylist()):
                order = np.lexsort((h, doc))
                d, x = doc[order], h[order]
                new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (x[1:] != x[:-1])])) if len(d) else d
                n = np.diff(np.concatenate([new, [len(d)]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[d[new]]), pa.array(x[new].view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int8))], ["doc", "h", "n"]
                )

    anchors = texts.mapInArrow(run, "doc long, h long, n byte")
    repeated = anchors.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    # which side is small depends on the corpus: merged at any size, and split by Spark where an anchor is very common
    own = anchors.select("doc", "h").join(repeated.hint("merge"), "h").groupBy("doc").agg(F.collect_set("h").alias("anchors"))
    return common.written(own, "substring-anchors")


def _contexts(candidates: DataFrame) -> DataFrame:
    """h, context, off, doc, at: different contexts with repeated anchors, the anchor's place in them, and their earliest
    places."""

    def run(batches):
        for batch in batches:
            docs, texts = batch.column("doc").to_numpy(), batch.column("text").to_pylist()
            known = [np.sort(x.values.to_numpy().view(np.uint64)) for x in batch.column("anchors")]
            out: dict = {}
            for doc, a, b, p, h in text_contexts(texts):
                # a text's parts come one after the other; equal contexts of one text keep the first place
                out = {c: None for c in out if len(doc) and c[0] == doc[0]}
                edge = np.searchsorted(doc, np.arange(len(texts) + 1))
                for i in np.unique(doc):
                    s = slice(edge[i], edge[i + 1])
                    hit = np.minimum(np.searchsorted(known[i], h[s]), len(known[i]) - 1)
                    for k in np.flatnonzero(known[i][hit] == h[s]) + edge[i]:
                        out.setdefault((int(i), texts[i][a[k] : b[k] + LENGTH]), (h[k], p[k] - a[k], a[k]))
                new = {c: v for c, v in out.items() if v}
                if new:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.array([v[0] for v in new.values()], np.uint64).view(np.int64)),
                            pa.array([c for _, c in new], pa.binary()),
                            pa.array(np.array([v[1] for v in new.values()], np.int32)),
                            pa.array(docs[[i for i, _ in new]]),
                            pa.array(np.array([v[2] for v in new.values()], np.int64)),
                        ],
                        ["h", "context", "off", "doc", "at"],
                    )

    return _earliest(candidates.mapInArrow(run, "h long, context binary, off int, doc long, at long"))


def _earliest(rows: DataFrame) -> DataFrame:
    """Equal contexts of an anchor as one row, that of their earliest place (partial minima before the shuffle)."""
    first = F.min(F.struct("doc", "at")).alias("x")
    return common.written(rows.groupBy("h", "context").agg(F.min("off").alias("off"), first).select("h", "context", "off", "x.doc", "x.at"), "substring-contexts")


def halves(context: bytes, off: int, low: int, high: int):
    """The windows of a context, whose begins lie ``low`` to ``high`` bytes before the anchor, parted in two: of each part
    the key (hash of the bytes that all its windows have around the anchor), and where in the context it begins and
    ends."""
    from xxhash import xxh64_intdigest

    middle = (low + high) // 2
    for a, b in ((low, middle), (middle + 1, high)):
        nearest, farthest = max(a, off - (len(context) - LENGTH)), min(b, off)
        if nearest <= farthest:
            key = xxh64_intdigest(context[off - a : off - b + LENGTH], a << 8 | b)
            yield key, off - farthest, off - nearest + LENGTH


def _parted(found: DataFrame, step: int) -> DataFrame:
    """Contexts as in ``found`` with the keys of the halves of their parts; step: how often that has been done."""

    def run(batches):
        for batch in batches:
            keys, texts, offs, docs, ats = [], [], [], [], []
            for context, off, doc, at in zip(*(batch.column(c).to_pylist() for c in ("context", "off", "doc", "at")), strict=True):
                low, high = part_of(off - (len(context) - LENGTH), off, step)
                for key, begin, end in halves(context, off, low, high):
                    keys.append(key), texts.append(context[begin:end]), offs.append(off - begin), docs.append(doc), ats.append(at + begin)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(texts, pa.binary()), pa.array(offs, pa.int32()), pa.array(docs, pa.int64()), pa.array(ats, pa.int64())],
                ["h", "context", "off", "doc", "at"],
            )

    return _earliest(found.mapInArrow(run, "h long, context binary, off int, doc long, at long"))


def part_of(nearest: int, farthest: int, step: int) -> tuple[int, int]:
    """The part, after ``step`` halvings of all distances that an anchor can have, in which these distances lie."""
    low, high = 0, LENGTH - ANCHOR
    for _ in range(step):
        middle = (low + high) // 2
        low, high = (low, middle) if farthest <= middle else (middle + 1, high)
    return low, high


def _first_occurrences(found: DataFrame, group_contexts: int) -> DataFrame:
    """doc, start, size: runs of windows that are the first of their kind."""
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready, left, step = None, found, 0
    while True:
        large = left.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_contexts).select("h")
        small, step = left, step + 1
        if step <= STEPS:
            large = common.written(large, "substring-anchors", True)
            small = left.join(large, "h", "left_anti")
        ready = small if ready is None else ready.unionByName(small)
        if step > STEPS or not large.head(1):
            break
        left = _parted(left.join(large, "h", "left_semi"), step - 1)

    def run(batches):
        texts, docs, places, total = [], [], [], 0
        for t in whole_groups(batches, 1):
            h, doc, at = (t.column(c).to_numpy() for c in ("h", "doc", "at"))
            context = t.column("context")
            edge = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
            single = edge[:-1][np.diff(edge) == 1]
            if len(single):  # windows of one context are all different
                size = np.array([len(context[int(k)].as_py()) for k in single]) - LENGTH + 1
                yield pa.RecordBatch.from_arrays([pa.array(doc[single]), pa.array(at[single]), pa.array(size)], ["doc", "start", "size"])
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                if j - i > 1:
                    own = context.slice(int(i), int(j - i)).to_pylist()
                    texts += own
                    docs.append(doc[i:j])
                    places.append(at[i:j])
                    total += sum(map(len, own))
                    if total > BLOCK_BYTES:
                        yield _runs(*first_windows(texts, np.concatenate(docs), np.concatenate(places)))
                        texts, docs, places, total = [], [], [], 0
        if texts:
            yield _runs(*first_windows(texts, np.concatenate(docs), np.concatenate(places)))

    gathered = ready.repartition(n, "h").sortWithinPartitions("h")
    return gathered.select("h", "context", "doc", "at").mapInArrow(run, "doc long, start long, size long")


def removed_spans(texts: list[bytes], anchors: list[np.ndarray], firsts: list[np.ndarray]):
    """(text number, [span, (begin, end)]) of the bytes in repeated windows, for each text that has some. anchors: sorted
    hashes; firsts: [run, (start, size)] of first occurrences; both of each text. Texts are handled by lots."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    for i, j in common.cut(sizes, CHUNK_BYTES):
        begins = np.cumsum(sizes[i:j]) - sizes[i:j]
        total = int(sizes[i:j].sum())
        candidate, kept, edge = (np.zeros(total + 1, np.int32) for _ in range(3))
        for doc, a, b, _, h in text_contexts(texts[i:j]):
            cuts = np.searchsorted(doc, np.arange(j - i + 1))
            for k in np.flatnonzero(np.diff(cuts)):
                s, own = slice(cuts[k], cuts[k + 1]), anchors[i + k]
                hit = own[np.minimum(np.searchsorted(own, h[s]), len(own) - 1)] == h[s]
                np.add.at(candidate, begins[k] + a[s][hit], 1)
                np.add.at(candidate, begins[k] + b[s][hit] + 1, -1)
        runs = np.concatenate([f + [[begins[k], 0]] for k, f in enumerate(firsts[i:j])])
        np.add.at(kept, runs[:, 0], 1)
        np.add.at(kept, runs[:, 0] + runs[:, 1], -1)
        again = np.flatnonzero((np.cumsum(candidate) > 0) & (np.cumsum(kept) <= 0))
        np.add.at(edge, again, 1)
        np.add.at(edge, again + LENGTH, -1)
        gone = np.cumsum(edge[:-1]) > 0
        first, last = np.zeros(total, bool), np.zeros(total, bool)  # of a text
        first[begins[sizes[i:j] > 0]] = True
        last[(begins + sizes[i:j] - 1)[sizes[i:j] > 0]] = True
        start = np.flatnonzero(gone & (first | ~np.concatenate([[False], gone[:-1]])))
        end = np.flatnonzero(gone & (last | ~np.concatenate([gone[1:], [False]]))) + 1
        of = np.searchsorted(begins, start, "right") - 1
        cuts = np.searchsorted(of, np.arange(j - i + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            s = slice(cuts[k], cuts[k + 1])
            yield i + int(k), np.stack([start[s], end[s]], 1) - begins[k]


def repeats(docs: DataFrame, group_contexts: int = GROUP_CONTEXTS, decoded: bool = False) -> tuple[DataFrame, DataFrame]:
    """All rows, doc (the id), sha, n_bytes, whole (the text is an earlier one's); changed texts: doc, sha, kept (the
    bytes left, or if ``decoded`` their whole characters as a string), n_removed, n_spans, spans."""
    common.tune(docs.sparkSession)
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).cast("binary").alias("text")
    )
    marked = common.written(rows.select("doc", F.sha2("text", 256).alias("sha"), F.length("text").cast("long").alias("n_bytes")), "substring-texts")
    first = marked.where(F.col("n_bytes") >= LENGTH).groupBy("sha").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select("sha", "rep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    marked = common.written(
        marked.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(first, ["sha", "salt"], "left").select("doc", "sha", "n_bytes", F.coalesce(F.col("doc") > F.col("rep"), F.lit(False)).alias("whole")),
        "substring-rows",
    )
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the texts move once, to buckets by id; the hash of a copy counts too, as another text may have the same id
    copies = marked.where("whole").groupBy("doc").agg(F.collect_set("sha").alias("gone"))
    texts = rows.where(F.length("text") >= LENGTH).repartition(n, "doc").join(copies.hint("merge"), "doc", "left")
    texts = texts.where("gone IS NULL OR NOT array_contains(gone, sha2(text, 256))").select("doc", "text")
    texts = common.bucketed(texts, "doc", "substring-distinct")
    candidates = texts.join(_anchors(texts).hint("merge"), "doc")
    found = _contexts(candidates)
    firsts = common.written(
        _first_occurrences(found, group_contexts)
        .groupBy("doc")
        .agg(F.collect_list(F.struct("start", "size")).alias("firsts")),
        "substring-firsts",
    )
    common.drop_written(found)

    def run(batches):
        names = ["doc", "sha", "kept", "n_removed", "n_spans", "spans"]
        for batch in batches:
            out, texts = [], batch.column("text").to_pylist()
            anchors = [np.sort(x.values.to_numpy().view(np.uint64)) for x in batch.column("anchors")]
            firsts = [np.stack([x.values.field(c).to_numpy() for c in ("start", "size")], 1) if x.is_valid else np.zeros((0, 2), np.int64) for x in batch.column("firsts")]
            docs = batch.column("doc").to_pylist()
            for k, spans in removed_spans(texts, anchors, firsts):
                text = texts[k]
                edges = [0, *spans.reshape(-1).tolist(), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                pairs = [{"begin": a, "end": b} for a, b in spans.tolist()]
                out.append((docs[k], hashlib.sha256(text).hexdigest(), kept.decode("utf-8", "ignore") if decoded else kept, len(text) - len(kept), len(spans), pairs))
            span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
            kinds = [pa.int64(), pa.string(), pa.string() if decoded else pa.binary(), pa.int64(), pa.int64(), pa.list_(span)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    changed = (
        candidates.join(firsts.hint("merge"), "doc", "left")
        .select("doc", "text", "anchors", "firsts")
        .mapInArrow(run, f"doc long, sha string, kept {'string' if decoded else 'binary'}, n_removed long, n_spans long, spans array<struct<begin:long,end:long>>")
    )
    return marked, changed


def op2_suffix_dedup(spark, sf_dir):
    rows, changed = repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    changed = changed.select("doc", "sha", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")).dropDuplicates(["doc", "sha"])
    none = F.sha2(F.lit("").cast("binary"), 256)
    return rows.join(changed, ["doc", "sha"], "left").select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"),
        "n_bytes",
        F.when(F.col("whole"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("whole"), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("whole"), none).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def stage_substrings(spark, docs, sf_dir):
    """Documents without their repeated strings; those of which nothing is left go. Characters of which a part is
    removed go entirely."""
    # decoded where it is made: a second Python step in the same tasks would need twice as many workers
    rows, changed = repeats(docs, decoded=True)
    own_doc, own_sha, own_new = (common.OWN + x for x in ("doc", "sha", "new"))
    new = changed.select("doc", "sha", F.col("kept").alias("new"))
    gone = rows.where("whole").select("doc", "sha", F.lit("").alias("new"))
    new = new.unionByName(gone).dropDuplicates(["doc", "sha"]).toDF(own_doc, own_sha, own_new)
    keyed = docs.withColumns(
        {
            own_doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)),
            own_sha: F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256),
        }
    )
    joined = keyed.join(new, [own_doc, own_sha], "left")
    out = joined.where(F.col(own_new).isNull() | (F.col(own_new) != "")).withColumn("text", F.coalesce(own_new, "text"))
    if "n_chars" in docs.columns:
        size = F.length("text").try_cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(own_new).isNull(), F.col("n_chars")).otherwise(size))
    return out.select(*docs.columns)
