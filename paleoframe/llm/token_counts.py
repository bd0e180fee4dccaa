"""Token counts of whole texts by a two-tier table of pre-token lengths, without a shuffle.

A byte-level BPE tokenizer first parts a text into pre-tokens and encodes each by itself, so the tokens of a text are the
sum of its pre-tokens' lengths. The first tier is a compact hash table of frequent pre-tokens and their lengths, made once
on the driver and broadcast: the pre-tokens that the vocabulary holds whole, which stand in it by their frequency in the
text it was made of, at most ``TABLE`` of them, so its size does not depend on the data. What misses goes to a cache in
each worker process, filled by whole batches through the library; no pre-token leaves its task.

Pre-tokens are found by a regular expression. Its character classes may be of another Unicode version than the library's:
characters on which the two differ are looked up once, and a text with one of them is parted by the library instead.

Defined results: a null or empty text has no tokens; strings of special tokens inside texts count as the library counts
them by default (one token); repeated rows give repeated results; ids are passed through, null ones too; an empty table
gives no rows; other columns of the input are kept unless they have the name of a result, which then replaces them. A
worker holds one batch's pre-tokens at a time, of a longer text ``BLOCK`` at a time.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: The tokenizer of the query, by its name among the public ones; functions take any path.
NAME = "byte_bpe_50k.json"
LIMIT = 1024
#: Most entries of the broadcast table.
TABLE = 65_536
#: Code points of texts handled at once; pre-tokens of one text listed at once; code points that a worker's cache keeps.
CHUNK_CHARS, BLOCK, CACHE_CHARS = 400_000, 100_000, 16_000_000
#: Characters whose class is compared at once.
PART = 10_000

RESULT = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(NAME)


@dataclass(frozen=True)
class Spec:
    """What workers get: the tokenizer's file as a string, the first tier and the characters left to the library."""

    source: str
    pattern: str
    special: tuple[str, ...]
    table: dict[str, int]
    differing: str


def _library(source: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(source)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _lengths(tok, tokens: list[str]) -> list[int]:
    return [len(e.ids) for e in tok.encode_batch_fast(tokens, add_special_tokens=False)]


def _byte_of_char() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _differing(tok, rx) -> str:
    """Characters that the expression and the library class differently. All of a class, end to end behind one of its
    members (in parts, as the library's offsets take longer in long texts), are one pre-token; where the library sees
    several, each is asked whether it is of the class."""
    import regex

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    parted = lambda t: [t[i:j] for _, (i, j) in tok.pre_tokenizer.pre_tokenize_str(t)]
    odd: list[str] = []
    for first, kind in (("a", r"\p{L}"), ("1", r"\p{N}"), ("!", r"[^\s\p{L}\p{N}]")):
        chars = "".join(regex.findall(kind, every))
        for i in range(0, len(chars), PART):
            pieces = parted(first + chars[i : i + PART])
            odd += [p for p in pieces if len(pieces) > 1 and len(parted(first + p)) > 1]
    spaces = regex.findall(r"\s", every)
    for c in spaces:
        text = f"a{c}1{c}!{c}a"
        if parted(text) != rx.findall(text):
            odd.append(c)
    return "".join(odd)


@lru_cache(maxsize=4)
def load(path: str, size: int = TABLE) -> Spec:
    """The tokenizer at ``path``; only plain byte-level BPE files are taken."""
    import regex

    with open(path, encoding="utf-8") as f:
        source = f.read()
    j = json.loads(source)
    pre, model = j["pre_tokenizer"] or {}, j["model"]
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not j["normalizer"]
    added = j["added_tokens"]
    if model["type"] != "BPE" or not plain or any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
        raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
    # the fixed expression of byte-level pre-tokenizers
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    rx, tok, special = regex.compile(pattern), _library(source), tuple(a["content"] for a in added)
    byte = _byte_of_char()
    words: list[str] = []
    for name in sorted(model["vocab"], key=model["vocab"].get):
        try:
            word = bytes(byte[c] for c in name).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if len(words) < size and word not in special and rx.findall(word) == [word]:
            words.append(word)
    return Spec(source, pattern, special, dict(zip(words, _lengths(tok, words), strict=True)), _differing(tok, rx))


class Lengths(dict):
    """The first tier. What it lacks is looked up in the worker's cache, which ``learn`` has filled before."""

    def __init__(self, spec: Spec):
        import regex

        super().__init__(spec.table)
        self.tok, self.cache, self.held = _library(spec.source), {}, 0
        self.find = regex.compile(spec.pattern)
        self.special = regex.compile("|".join(map(regex.escape, sorted(spec.special, key=len, reverse=True)))) if spec.special else None
        self.differing = frozenset(spec.differing)

    def __missing__(self, token: str) -> int:
        return self.cache[token]

    def learn(self, tokens: set[str]) -> None:
        if self.held > CACHE_CHARS:
            self.cache.clear()
            self.held = 0
        new = [t for t in tokens if t not in self and t not in self.cache]
        self.cache.update(zip(new, _lengths(self.tok, new), strict=True))
        self.held += sum(map(len, new))

    def parted(self, text: str) -> tuple[int, list]:
        """The number of special tokens in ``text``, and iterables of the pre-tokens between them."""
        parts = self.special.split(text) if self.special else [text]
        out = []
        for p in parts:
            if not p.isascii() and not self.differing.isdisjoint(p):
                out.append([p[i:j] for _, (i, j) in self.tok.pre_tokenizer.pre_tokenize_str(p)])
            elif len(p) > CHUNK_CHARS:
                out.append(m.group() for m in self.find.finditer(p))
            else:
                out.append(self.find.findall(p))
        return len(parts) - 1, out

    def count(self, texts: list[str]) -> list[int]:
        if len(texts) == 1 and len(texts[0]) > CHUNK_CHARS:
            n, parts = self.parted(texts[0])
            tokens = chain.from_iterable(parts)
            while block := list(islice(tokens, BLOCK)):
                n += self._sum(block)
            return [n]
        found = [(n, list(chain.from_iterable(parts))) for n, parts in map(self.parted, texts)]
        self.learn(set(chain.from_iterable(tokens for _, tokens in found)))
        return [n + sum(map(self.__getitem__, tokens)) for n, tokens in found]

    def _sum(self, tokens: list[str]) -> int:
        self.learn(set(tokens))
        return sum(map(self.__getitem__, tokens))


_workers: dict[str, Lengths] = {}


def _worker(key: str, spec) -> Lengths:
    """This process's table and cache; they outlive a task."""
    if key not in _workers:
        _workers.clear()
        _workers[key] = Lengths(spec.value)
    return _workers[key]


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT, size: int = TABLE) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit, which replace columns of these names. The tokenizer's file is read
    on the driver; workers get its contents."""
    spark = docs.sparkSession
    common.tune(spark)
    # columns go by place through the workers: names may be repeated
    names, own = [f"c{k}" for k in range(len(docs.columns))], common.OWN + "n"
    at = names[docs.columns.index(text)]
    key, spec = f"{path}:{size}", spark.sparkContext.broadcast(load(path, size))

    def run(batches):
        lengths = _worker(key, spec)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for i, j in common.cut(map(len, texts), CHUNK_CHARS):
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(i, j - i).columns, pa.array(lengths.count(texts[i:j]), pa.int64())], [*names, own]
                )

    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields, strict=True)] + [T.StructField(own, T.LongType())])
    new = [f.name for f in RESULT]
    return docs.toDF(*names).mapInArrow(run, schema).select(
        *[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c not in new],
        F.coalesce(F.octet_length(at), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(own).alias("n_tokens"),
        (F.col(own) > limit).alias("over_limit"),
    )


def op13_token_counts(spark, sf_dir):
    return count_tokens(common.table(spark, sf_dir, "documents").select("doc_id", "text"), default_path()).drop("text")
