"""Queries against brute force where the SQL, or the lack of it, leaves rows unseen."""

import os
from collections import Counter

import pytest

from paleoframe.plans import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_base_decode_counts_whole_texts(spark, tmp_path):
    texts = ["ACGTacgt0123 N" * 40 + "é", "x" * 250 + "Zz😀", "", None, "short\nlines\n"]
    spark.createDataFrame([(t,) for t in texts], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    code = {c: k % 4 for k, c in enumerate("ACGTacgt0123")}
    want = {(c, code.get(c, 4), n) for c, n in Counter("".join(t or "" for t in texts)).items()}
    assert {(r.b, r.code, r.n) for r in queries.base_decode(spark, str(tmp_path)).collect()} == want


@pytest.mark.skipif(not os.path.exists(f"{DATA}/events.parquet"), reason="no test data")
def test_ref_reconstruct_rebuilds_every_eligible_read(spark):
    want = []
    for r in queries.aligned(spark, DATA).select("read_id", "length", "read", "pos").collect():
        kind, n = r.read_id % 3, r.length
        head, tail, named = ((3, 5, 7), (2, 7, 12), (5, 0, None))[kind]
        ref = [4] * head + list(r.read[head : n - tail]) + [4] * tail
        if named is not None:
            ref[named] = 0
        # after the intron of 5 and the deletion of 3
        off = [i - head + (0 if kind != 1 or i < 13 else 5 if i < 18 else 8) for i in range(n)]
        places = ["-" if ref_code else str(r.pos + k) for ref_code, k in zip([i < head or i >= n - tail for i in range(n)], off, strict=True)]
        want.append((r.read_id, n, "".join(map(str, ref)), "".join(map(str, r.read)), ",".join(places)))
    assert min(r[1] for r in want) < 40
    assert sorted(map(tuple, queries.ref_reconstruct(spark, DATA).collect())) == sorted(want)
