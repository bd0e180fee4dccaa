"""Language identification by multilingual mixture inference.

Training sums hashed character trigrams by language over every training row (partial sums in each task, one small
shuffle); the model is one row of log-likelihoods a bucket, languages x BUCKETS numbers however large the corpus is.

A document is cut into segments of SEGMENT trigrams. Expectation-maximisation over the segments estimates the share of
each language; languages are then taken out one by one, the smallest share first, and of the sets on that way the one
with the best log-likelihood less PENALTY * size * ln(segments + 1) is kept. The prediction is the language with the
largest share in that set, the score its share.

Defined results: null texts and texts without a letter are ``und`` with score 0, as are all texts if there is nothing to
learn from; equal shares go to the language first in order; rows with a null language or id are never learnt from, and
a null id counts as held out; repeated rows count as often as they occur; an empty table gives no rows; other columns are
kept, but ``lang_pred`` and ``score`` are replaced. A task holds CELLS numbers, or for a longer text some 60 bytes a
character. The model has BUCKETS numbers a language and goes to every task; LANGUAGES is the most it may have.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .ngrams import char_grams, code_points

BITS, ORDER = 15, 3
SEGMENT = 48
STEPS = 8
PENALTY = 3.0
SMOOTH = 0.5
#: More languages than that are an error: such a column holds something else.
LANGUAGES = 1000
#: Numbers of the largest array at once.
CELLS = 1_600_000

RESULT = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    cps, ends = code_points([t.lower() for t in texts])
    ascii_other = (cps < 97) | ((cps > 122) & (cps < 128))
    return char_grams(np.where(ascii_other, np.uint32(32), cps), ORDER, BITS), ends


def _lower_lens(texts: list[str]) -> list[str]:
    return [t or "" for t in texts]


def learn(rows: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and log-likelihoods [bucket, language]. Every row of ``rows`` with a language counts."""
    common.tune(rows.sparkSession)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = _lower_lens(batch.column(0).to_pylist()), batch.column(1).to_pylist()
            for i, j in common.cut(map(len, texts), 400_000):
                buckets, ends = _grams(texts[i:j])
                begins = np.concatenate([[0], ends[:-1]])
                for k, name in enumerate(langs[i:j]):
                    own = buckets[begins[k] : ends[k] - 2]  # without the trigrams that reach into the next text
                    if name not in sums:
                        sums[name] = np.zeros(1 << BITS, np.int64)
                    sums[name] += np.bincount(own, minlength=1 << BITS) if len(own) > 4096 else 0
                    if len(own) <= 4096:
                        np.add.at(sums[name], own, 1)
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], ["lang", "bucket", "n"]
            )

    found = rows.where(F.col(lang).isNotNull()).select(lang).distinct().limit(LANGUAGES + 1).count()
    if found > LANGUAGES:
        raise ValueError(f"{lang} has over {LANGUAGES} values")
    counts = (
        rows.where(F.col(lang).isNotNull())
        .select(text, lang)
        .mapInArrow(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    langs = sorted(set(counts["lang"].to_pylist()))
    n = np.zeros((1 << BITS, len(langs)))
    if langs:
        at = np.searchsorted(np.array(langs, object), np.array(counts["lang"].to_pylist(), object))
        n[counts["bucket"].to_numpy(), at] = counts["n"].to_numpy()
    return langs, np.log((n + SMOOTH) / (n.sum(0) + SMOOTH * len(n))).astype(np.float32)


def shares(seg: np.ndarray, doc: np.ndarray, nd: int) -> np.ndarray:
    """Chosen shares [document, language] from log-likelihoods [segment, language] in order of documents."""
    nl = seg.shape[1]
    begins = np.searchsorted(doc, np.arange(nd))
    size = np.bincount(doc, minlength=nd)
    top = seg.max(1, keepdims=True)
    like = np.exp(np.maximum(seg - top, -60.0)).astype(np.float64)

    def fit(pi):
        for _ in range(STEPS):
            r = like * pi[doc]
            r /= r.sum(1, keepdims=True)
            pi = np.add.reduceat(r, begins, axis=0) / size[:, None]
        return pi

    def value(pi, active):
        ll = np.add.reduceat(np.log((like * pi[doc]).sum(1)) + top[:, 0], begins)
        return ll - PENALTY * active.sum(1) * np.log(size + 1)

    active = np.ones((nd, nl), bool)
    pi = fit(np.full((nd, nl), 1.0 / nl))
    best, best_value = pi.copy(), value(pi, active)
    # at first all that have next to no share, then one at a time
    drop = pi < 0.01
    drop[np.arange(nd), pi.argmax(1)] = False
    while True:
        if not drop.any():
            many = active.sum(1) > 1
            if not many.any():
                return best
            smallest = np.where(active, pi, np.inf).argmin(1)
            drop[np.flatnonzero(many), smallest[many]] = True
        active &= ~drop
        drop = np.zeros_like(drop)
        pi = np.where(active, np.maximum(pi, 1e-12), 0.0)
        pi = fit(pi / pi.sum(1, keepdims=True))
        pi = np.where(active, pi, 0.0)
        v = value(np.maximum(pi, 1e-300), active)
        better = v > best_value
        best[better], best_value = pi[better], np.where(better, v, best_value)


def predict(texts: list[str], langs: list[str], table: np.ndarray) -> tuple[list[str], np.ndarray]:
    known = [bool(langs) and any(map(str.isalpha, t)) for t in texts]
    names, score = ["und"] * len(texts), np.zeros(len(texts))
    at = np.flatnonzero(known)
    if len(at):
        buckets, ends = _grams([texts[i] for i in at])
        buckets = np.concatenate([buckets, np.zeros(2, np.int64)])
        begins = np.concatenate([[0], ends[:-1]])
        per = -(-(ends - begins - 2) // SEGMENT)
        seg_doc = np.repeat(np.arange(len(at)), per)
        place = np.arange(len(seg_doc)) - np.repeat(np.cumsum(per) - per, per)
        seg_at = begins[seg_doc] + place * SEGMENT
        like = table[buckets]
        for e in ends:
            like[e - 2 : e] = 0  # trigrams that are only a gap
        pi = shares(np.add.reduceat(like, seg_at, axis=0), seg_doc, len(at))
        top = pi.argmax(1)
        score[at] = np.clip(pi[np.arange(len(at)), top], 0.0, 1.0)
        for i, k in zip(at, top, strict=True):
            names[i] = langs[k]
    return names, score


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, which replace columns of these names."""
    common.tune(docs.sparkSession)
    langs, table = model
    keep = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    names = [f.name for f in keep]
    most = CELLS // max(1, len(langs))

    def run(batches):
        for batch in batches:
            texts = _lower_lens(batch.column(text).to_pylist())
            for i, j in common.cut(map(len, texts), most):
                got, score = predict(texts[i:j], langs, table)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array(got, pa.string()), pa.array(score)], [*names, "lang_pred", "score"]
                )

    return docs.select(*names).mapInArrow(run, T.StructType(keep + RESULT))


def op3_language_id(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    part = common.id_mod("doc_id", 4)
    model = learn(docs.where(part != 2).select("text", "lang"))
    return identify(docs.select("doc_id", F.coalesce(part == 2, F.lit(True)).alias("held_out"), "text"), model).drop("text")
