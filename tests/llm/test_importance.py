"""Importance resampling against plain Python, with texts cut into overlapping chunks."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from paleoframe.llm import importance

from .test_ops import ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = [(20 + k, " ".join(f"word{(k * j) % 97} Ünter, {'z' * (j % 70)}" for j in range(400))) for k in range(12)]
SHORT = [(100 + k, " ".join(f"{c}{k % 7}" for c in "the quick brown fox jumps over a lazy dog and then it sleeps for the rest of this day".split())) for k in range(60)]
TARGET = [(1, "The quick BROWN fox"), (2, None), (3, "word1 word2 word3 ünter"), (4, "")]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def buckets(text, n, of):
    w = WORD.findall(lowered(text))
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % of for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def by_force(docs, target, n, of, percent, least, seed):
    s, t = np.zeros(of), np.zeros(of)
    for counts, rows in ((s, docs), (t, target)):
        for _, text in rows:
            for b in buckets(text, n, of):
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + of) / ((s[b] + 1) * (t.sum() + of)))) for b in range(of)]
    out = []
    for i, text in docs:
        found = buckets(text, n, of)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None, len(WORD.findall(lowered(text)))])
    can = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is not None, x[0] or 0, x[1]))
    for rank, x in enumerate(can[: percent * len(can) // 100]):
        x[4] = rank + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


@pytest.mark.parametrize("n, of, percent, least, chunk", [(1, 10_000, 10, 20, 65_536), (3, 500, 50, 1, 300), (2, 64, 100, 0, 7)])
def test_resampling_by_force(spark, n, of, percent, least, chunk):
    docs = ODD + LONG + SHORT + SHORT[:5] + [(7, "Y" * 5000 + " " + "é" * 3000), (8, " ".join("a" * 30))]
    df = spark.createDataFrame([(*x, 1, "c") for x in docs], "doc_id long, text string, score int, chunk string")
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    got = importance.resample(df, target, n=n, buckets=of, percent=percent, min_words=least, chunk=chunk)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_force(docs, TARGET, n, of, percent, least, "2024")


def test_empty_tables(spark):
    docs, target = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(TARGET, "item_id long, text string")
    assert importance.resample(docs, target).collect() == []
    rows = spark.createDataFrame(SHORT[:3], "doc_id long, text string")
    got = importance.resample(rows, target.limit(0), percent=100, min_words=0).collect()
    assert sorted((tuple(r) for r in got), key=str) == by_force(SHORT[:3], [], 1, 10_000, 100, 0, "2024")


def test_chunks_own_each_word_once():
    for text in (LONG[3][1], "  lone  ", "a " * 500, "x" * 999, ODD[6][1] or ""):
        words = WORD.findall(lowered(text))
        for n in (1, 2, 4):
            for most in (1, 5, 64, 10_000):
                at = 0
                for chunk, own in importance.chunks(text.encode(), n, most):
                    got = WORD.findall(lowered(chunk.decode()))
                    assert got == words[at : at + own + n - 1][: len(got)] and len(got) >= min(own + n - 1, len(words) - at)
                    at += own
                assert at == len(words)
