"""Quality classifier: supervised subword embeddings, trained by stochastic gradient descent in numpy.

Words and character n-grams of three lengths of a document are hashed to BUCKETS learned vectors. The vectors of each kind
are averaged, the two averages are added and go through a softmax layer.

Training takes at most SAMPLE labelled rows, those with the smallest hashes of their ids, and of these, in that order, as
many as have FEATURES different features together (``SAMPLE`` and ``FEATURES`` are the documented bounds: the driver holds
eight bytes a feature); their features are made on the executors and only bucket counts reach the driver. Scoring is a sum
of one learned number a feature, over whole texts.

Defined results: a null or empty text scores the bias alone; without any label, or with labels of one kind, every score
is the smoothed share of label 1; a null id counts as held out; rows with null labels are not learnt from; of labels that
contradict each other the smaller one counts; repeated rows are scored each; an empty table gives no rows; other columns
are kept, but ``score`` and ``predicted`` are replaced. A task holds some 60 bytes a character of CHUNK_CHARS characters or
of the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .ngrams import char_grams, code_points, words

SAMPLE, FEATURES = 4000, 24_000_000
BITS = 14
GRAMS = (2, 3, 4)
DIM, STEPS, RATE, SEED = 8, 32_000, 0.5, 7
#: Gradient steps on a kind's vectors are larger by this, as each of many features has a small share of an average.
FEATURE_RATE = 60.0
WIDTH = 2 * (1 << BITS)  # buckets of words, then those of n-grams
CHUNK_CHARS = 400_000


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per kind: feature numbers and the text that each belongs to, in order of texts."""
    cps, ends = code_points(texts, " \n\n\n")
    begins = np.concatenate([[0], ends[:-1]])
    starts, _, word = words(cps)
    doc = np.searchsorted(ends, starts, "right")
    out = [((word >> np.uint64(64 - BITS)).astype(np.int64), doc)]
    size = ends - begins - 4
    inside = np.repeat(np.arange(len(texts)), np.maximum(size, 0))
    at = np.arange(len(inside)) + np.repeat(begins - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    grams = [char_grams(cps, n, BITS)[at] for n in GRAMS]
    out.append((np.stack(grams, 1).reshape(-1) + (1 << BITS), np.repeat(inside, len(GRAMS))))
    return out


def _sparse(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text: feature numbers and weights, each kind's adding up to one."""
    kinds = features(texts)
    edges = [np.searchsorted(doc, np.arange(len(texts) + 1)) for _, doc in kinds]
    out = []
    for i in range(len(texts)):
        ids, weights = [], []
        for (f, _), e in zip(kinds, edges, strict=True):
            own, n = np.unique(f[e[i] : e[i + 1]], return_counts=True)
            ids.append(own)
            weights.append(n / max(1, n.sum()))
        out.append((np.concatenate(ids), np.concatenate(weights)))
    return out


class Model:
    """weight: one number a feature; bias: log-odds of label 1 without features."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight.astype(np.float32), bias

    def score(self, texts: list[str]) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        for f, doc in features(texts):
            n = np.bincount(doc, minlength=len(texts))
            z += np.bincount(doc, weights=self.weight[f], minlength=len(texts)) / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], steps: int | None = None) -> Model:
    """Embedding and softmax layer by stochastic gradient descent over (feature numbers, weights, label). steps: stop
    after so many."""
    y = np.array([r[2] for r in rows], np.int64)
    share = (y.sum() + 1) / (len(y) + 2)
    bias = np.array([0.0, np.log(share / (1 - share))])
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(WIDTH), float(bias[1]))
    rng = np.random.default_rng(SEED)
    table = rng.uniform(-0.5, 0.5, (WIDTH, DIM)) / DIM
    layer = rng.uniform(-0.5, 0.5, (DIM, 2))
    epochs = -(-STEPS // len(rows))
    every = epochs * len(rows)
    for k, i in enumerate(np.concatenate([rng.permutation(len(rows)) for _ in range(epochs)])[:steps]):
        ids, weights, label = rows[i]
        rate = RATE * (1 - k / every)
        own = table[ids]
        v = weights @ own
        z = v @ layer + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[label] -= 1
        back = layer @ p
        layer -= rate * np.outer(v, p)
        bias -= 0.1 * rate * p
        table[ids] = own - (rate * FEATURE_RATE / len(ids) ** 0.5) * weights[:, None] * back
    out = table @ (layer[:, 1] - layer[:, 0])
    return Model(out, float(bias[1] - bias[0]))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit to the texts of doc_id, text that have a 0/1 label in doc_id, ``label``."""
    common.tune(docs.sparkSession)
    order = F.xxhash64("doc_id")
    marked = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("label"))
    )
    last = marked.select(order.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).head()[0]
    if last is None:
        return train([])

    def run(batches):
        for batch in batches:
            texts, own = [t or "" for t in batch.column(0).to_pylist()], batch.slice(0)
            for i, j in common.cut(map(len, texts), CHUNK_CHARS):
                got, part = _sparse(texts[i:j]), own.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(1),
                        part.column(2),
                        pa.array([len(a) for a, _ in got], pa.int64()),
                        pa.array([a.astype(np.int32) for a, _ in got], pa.list_(pa.int32())),
                        pa.array([b.astype(np.float32) for _, b in got], pa.list_(pa.float32())),
                    ],
                    ["label", "h", "n", "ids", "weights"],
                )

    # both sides are cut to the sample before they meet
    chosen = docs.where(order <= last).select("doc_id", "text").join(marked.where(order <= last), "doc_id")
    made = chosen.select("text", "label", order.alias("h")).mapInArrow(run, "label int, h long, n long, ids array<int>, weights array<float>")
    made = common.written(made.withColumn("row", F.monotonically_increasing_id()), "quality-features")
    # which rows to take follows from their sizes alone; features of no other row move
    key = F.struct("h", "n", "label", "row")
    sizes = made.select(key.alias("key")).orderBy("key").limit(sample).collect()
    if not sizes:
        return train([])
    taken = max(1, int((np.cumsum([r["key"]["n"] for r in sizes]) <= FEATURES).sum()))
    end = sizes[taken - 1]["key"]
    fit = made.where(key <= F.struct(*[F.lit(end[c]).cast(t).alias(c) for c, t in (("h", "long"), ("n", "long"), ("label", "int"), ("row", "long"))]))
    t = fit.select("label", "ids", "weights").toArrow()
    rows = [(ids.values.to_numpy(), weights.values.to_numpy(), y) for y, ids, weights in zip(t["label"].to_pylist(), t["ids"], t["weights"], strict=True)]
    rows.sort(key=lambda r: (len(r[0]), r[2], r[0].tobytes(), r[1].tobytes()))  # the same order in every run
    return train(rows)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score and predicted, which replace columns of these names."""
    common.tune(docs.sparkSession)
    keep = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    names = [f.name for f in keep]

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            for i, j in common.cut(map(len, texts), CHUNK_CHARS):
                s = model.score(texts[i:j])
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*names, "score", "predicted"]
                )

    result = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return docs.select(*names).mapInArrow(run, T.StructType(keep + result))


def op8_quality_classifier(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    part = common.id_mod("doc_id", 3)
    labels = common.table(spark, sf_dir, "labels").where(part != 1).select("doc_id", "quality")
    model = learn(docs, labels)
    return score(docs.withColumn("held_out", F.coalesce(part == 1, F.lit(True))), model).drop("text")
