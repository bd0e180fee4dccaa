"""Quality rules: how much of a document lies inside repeated n-grams and repeated lines.

Documents of an Arrow batch are laid end to end as one array of code points. Words and lines get 64-bit polynomial
hashes, word n-grams get rolling hashes of the word hashes, and equal hashes inside one document are found by sorting.
Everything is per document, so there is no shuffle.

Words are ``[^\\x20\\x09-\\x0D]+``. Defined results: a null text has no words and fails the base rule; repeated rows
give repeated results; ids are passed through, null ones too; an empty table gives no rows; other columns of the input
are kept by ``flag_quality`` unless they clash with its result columns, which then replace them. Memory follows the
largest single document (about 150 bytes a code point), not the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

#: Code points handled at once.
CHUNK_CHARS = 400_000
#: n-gram lengths in words -> largest share of the word characters that duplicated n-grams may cover.
NGRAM_LIMITS = {5: 0.55, 8: 0.50, 10: 0.45}
#: Largest share of the characters that lie in lines equal to an earlier line.
DUP_LINE_CHARS_LIMIT = 0.40
#: Largest number of symbols in a hundred words.
SYMBOL_PERCENT = 20
MIN_WORDS, BASE_NGRAM, BASE_PERCENT = 50, 3, 50
SYMBOLS = "#*$%&|<>"

RESULT = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    + [T.StructField(f"covered_{n}", T.LongType()) for n in NGRAM_LIMITS]
    + [T.StructField("dup_line_chars", T.LongType())]
)

_M1, _M2, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x100000001B3)
_powers = np.ones(1, np.uint64)
_symbol = np.zeros(128, bool)
_symbol[[ord(c) for c in SYMBOLS]] = True


def _pow(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 4096)
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _BASE, np.uint64)]), dtype=np.uint64)
        if size > 1 << 20:  # of one very long line; not kept
            out, _powers = _powers, _powers[:4096].copy()
            return out
    return _powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def _duplicated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every key: does it occur twice or more; is there an equal key before it."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    later[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, later


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """The counts of RESULT for each text, without the verdicts."""
    nd = len(texts)
    cps = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])  # of the documents, each with one newline after it
    space = (cps == 32) | ((cps >= 9) & (cps <= 13))
    per_doc = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[np.concatenate([[0], ends])])
    out = {"n_symbols": per_doc((cps < 128) & _symbol[np.minimum(cps, 127)]), "word_chars": per_doc(~space)}
    mixed = cps.astype(np.uint64) * _M1
    mixed ^= mixed >> np.uint64(32)

    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    last = ~space
    last[:-1] &= space[1:]
    lens = np.flatnonzero(last) + 1 - starts
    doc = np.searchsorted(ends, starts, "right")
    out["n_words"] = np.bincount(doc, minlength=nd)
    covered = {n: np.zeros(nd, np.int64) for n in (BASE_NGRAM, *NGRAM_LIMITS)}
    out["n_repeat_words"] = np.zeros(nd, np.int64)
    if len(starts):
        at = np.concatenate([[0], np.cumsum(lens)[:-1]])
        inside = np.flatnonzero(~space)
        place = np.arange(len(inside)) - np.repeat(at, lens)
        word = _mix(np.add.reduceat(mixed[inside] * _pow(int(lens.max()))[place], at) + lens.astype(np.uint64))
        salt = _mix((doc + 1).astype(np.uint64) * _M1)
        gram, have = word, 1
        for n in sorted(covered):
            for _ in range(have, n):
                gram = gram[:-1] * _BASE + word[len(word) - len(gram) + 1 :] if len(gram) else gram
            have = n
            if not len(gram):
                continue
            whole = doc[: len(gram)] == doc[n - 1 :]
            at_n = np.flatnonzero(whole)
            again = at_n[_duplicated(_mix(gram[at_n]) ^ salt[at_n])[0]]
            edge = np.zeros(len(word) + 1, np.int32)
            edge[again] += 1
            edge[again + n] -= 1
            cover = np.cumsum(edge[:-1]) > 0
            covered[n] = np.bincount(doc[cover], weights=lens[cover], minlength=nd).astype(np.int64)
            if n == BASE_NGRAM:
                out["n_repeat_words"] = np.bincount(doc[cover], minlength=nd)
    for n in NGRAM_LIMITS:
        out[f"covered_{n}"] = covered[n]

    line_ends = np.flatnonzero(cps == 10) + 1
    line_starts = np.concatenate([[0], line_ends[:-1]])
    size = line_ends - line_starts
    words_before = np.concatenate([[0], np.cumsum(first)])
    # a line that begins inside no word has one if any word begins in it
    has = words_before[line_ends] > words_before[line_starts]
    place = np.arange(len(cps)) - np.repeat(line_starts, size)
    line = _mix(np.add.reduceat(mixed * _pow(int(size.max()))[place], line_starts) + size.astype(np.uint64))
    line_doc = np.searchsorted(ends, line_starts, "right")
    at_l = np.flatnonzero(has)
    key = line[at_l] ^ _mix((line_doc[at_l] + 1).astype(np.uint64) * _M1)
    dup = at_l[_duplicated(key)[1]]
    out["n_dup_lines"] = np.bincount(line_doc[dup], minlength=nd)
    out["dup_line_chars"] = np.bincount(line_doc[dup], weights=size[dup] - 1, minlength=nd).astype(np.int64)
    return out


def judge(m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > BASE_PERCENT * m["n_words"])
    good = ~failed & (100 * m["n_symbols"] <= SYMBOL_PERCENT * m["n_words"])
    for n, most in NGRAM_LIMITS.items():
        good &= m[f"covered_{n}"] <= most * m["word_chars"]
    good &= m["dup_line_chars"] <= DUP_LINE_CHARS_LIMIT * m["word_chars"]
    return m | {"base_failed": failed, "kept": good}


def flag_quality(docs: DataFrame, text: str = "text", only: str | None = None) -> DataFrame:
    """``docs`` with the columns of RESULT; with ``only``, with no column more than the verdict, under that name."""
    common.tune(docs.sparkSession)
    result = RESULT.fields if only is None else [T.StructField(only, T.BooleanType())]
    new = {f.name: f.name if only is None else "kept" for f in result}
    keep = [f for f in docs.schema.fields if f.name not in new]
    schema = T.StructType(keep + result)
    names = [f.name for f in keep]

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            for i, j in common.cut(map(len, texts), CHUNK_CHARS):
                got = judge(measure(texts[i:j]))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in names] + [pa.array(got[c]) for c in new.values()],
                    [*names, *new],
                )

    return docs.mapInArrow(run, schema)


def op10_quality_rules(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return flag_quality(docs).drop("text")


def stage_quality(spark, docs, sf_dir):
    """The documents that the rules keep, with all their columns as they are."""
    verdict = common.OWN + "kept"
    return flag_quality(docs, only=verdict).where(verdict).select(*docs.columns)


_GRAMS = "\n".join(
    f"""  , g{n} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) > 1 AS again FROM (
      SELECT doc_id, i, list_slice(w, i, i + {n - 1}) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM words)))
  , c{n} AS (SELECT doc_id, count(*) AS words, sum(length(w[j])) AS chars FROM (
      SELECT DISTINCT doc_id, i + unnest(range({n})) AS j FROM g{n} WHERE again) JOIN words USING (doc_id) GROUP BY doc_id)"""
    for n in (BASE_NGRAM, *NGRAM_LIMITS)
)
OP10_SQL = rf"""
WITH words AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)
{_GRAMS}
  , lines AS (SELECT doc_id, l, count(*) - 1 AS more FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM words)
      WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l)
  , dup AS (SELECT doc_id, sum(more) AS n, sum(more * length(l)) AS chars FROM lines GROUP BY doc_id)
  , m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c{BASE_NGRAM}.words, 0) AS BIGINT) AS n_repeat_words,
      {", ".join(f"CAST(coalesce(c{n}.chars, 0) AS BIGINT) AS covered_{n}" for n in NGRAM_LIMITS)},
      CAST(coalesce(dup.chars, 0) AS BIGINT) AS dup_line_chars
    FROM words LEFT JOIN dup USING (doc_id) {" ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in (BASE_NGRAM, *NGRAM_LIMITS))})
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words)
  AND {" AND ".join(f"covered_{n} <= {x}::DOUBLE * word_chars" for n, x in NGRAM_LIMITS.items())}
  AND 100 * n_symbols <= {SYMBOL_PERCENT} * n_words AND dup_line_chars <= {DUP_LINE_CHARS_LIMIT}::DOUBLE * word_chars AS kept
FROM m
"""
