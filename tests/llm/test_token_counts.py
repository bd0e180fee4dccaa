"""Token counts against the tokenizers library."""

import os
import random

import pytest

from paleoframe.llm import token_counts

from .test_ops import ODD

public = pytest.importorskip("public_tokenizers")
PATH = token_counts.default_path()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def texts():
    r = random.Random(5)
    pick = lambda: r.choice([r.randrange(32, 127), r.randrange(0xA0, 0x3100), r.choice([9, 10, 13, 32, 0x85, 0xA0, 0x3000, 0x200B, 0x2028]), r.randrange(0x1F000, 0x20000)])
    out = ["", None, "a<|endoftext|>b", "<|endoftext|><|endoftext|> ", "<|endoftext", "  \n\n x　 y'll don't I'M", "\x00\x1f a", "a" * 3000, " " * 500 + "x", "it's 12345 #*! \t\n"]
    out += ["".join(chr(pick()) for _ in range(r.choice([5, 50, 500]))) for _ in range(150)]
    return out + [t for _, t in ODD]


def test_counts_of_the_library(spark, library, monkeypatch):
    rows = [(k if k % 5 else None, t, "x") for k, t in enumerate(texts())]
    want = sorted((k or -1, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 20) for k, t, _ in rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = token_counts.count_tokens(df, PATH, limit=20)
    assert got.columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want
    # hardly a first tier: all but one come from the workers' caches
    small = token_counts.count_tokens(df, PATH, limit=20, size=1).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in small) == want
    assert token_counts.count_tokens(df.limit(0), PATH).collect() == []


def test_long_texts_and_small_caches(library, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK_CHARS", 200)
    monkeypatch.setattr(token_counts, "BLOCK", 7)
    monkeypatch.setattr(token_counts, "CACHE_CHARS", 50)
    lengths = token_counts.Lengths(token_counts.load(PATH, 10))
    some = [t or "" for t in texts()] + ["the cat sat<|endoftext|> on " * 300]
    assert [lengths.count([t])[0] for t in some] == [len(library.encode(t, add_special_tokens=False).ids) for t in some]


def test_classes_of_all_characters(library):
    """Each character of the Basic Multilingual Plane, and some beyond it, between others of each class."""
    lengths = token_counts.Lengths(token_counts.load(PATH, 1000))
    chars = [c for c in [*range(0x3500), *range(0xA000, 0xD800, 3), *range(0xE000, 0x20000, 7)] if not 0xD800 <= c < 0xE000]
    some = ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}!" for c in chars[i : i + 50]) for i in range(0, len(chars), 50)]
    assert lengths.count(some) == [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_counts.load(public.path("word_bpe_49k.json"))
