"""The pipeline against a brute-force one, stage by stage on each stage's own input."""

import os
import re

import pytest

import corpus_pipeline
from paleoframe.llm import common, quality_rules

from .test_near_sets import kept_by_force
from .test_ops import repeats_by_force

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.exists(f"{DATA}/documents.parquet"), reason="no test data")


def test_stages(spark):
    docs = common.table(spark, DATA, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    rules = common.written(stages["quality_rules"](spark, docs, DATA), "t")
    rows = docs.collect()
    good = quality_rules.judge(quality_rules.measure([r.text or "" for r in rows]))["kept"]
    assert sorted(r.doc_id for r in rules.collect()) == sorted(r.doc_id for r, k in zip(rows, good, strict=True) if k)

    near = common.written(stages["simhash"](spark, rules, DATA), "t")
    # the stage's rule is that of five-word shingles and similarity 0.8, not the two bits of op6
    words = lambda t: " ".join(re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")))
    want = kept_by_force([(r.doc_id, words(r.text)) for r in rules.collect()])
    assert sorted(r.doc_id for r in near.collect()) == want

    cut = common.written(stages["substrings"](spark, near, DATA), "t")
    want = {i: n - gone for i, n, gone, _, _ in repeats_by_force([(r.doc_id, r.text) for r in near.collect()])}
    got = {r.doc_id: r for r in cut.collect()}
    assert set(got) == {i for i, left in want.items() if left}
    for i, r in got.items():  # a character of which a part is removed goes entirely
        assert want[i] - 6 <= len(r.text.encode()) <= want[i] and r.n_chars == len(r.text)

    mixed = common.written(stages["mixing"](spark, cut, DATA), "t")
    assert {r.doc_id for r in mixed.collect()} <= set(got)
    for stage in (rules, near, cut, mixed):
        assert stage.columns == columns
    assert stages["pieces"](spark, mixed, DATA).count() == mixed.count() and names == ["quality_rules", "simhash", "substrings", "mixing", "pieces"]


def test_substring_tasks_have_one_python_step(spark):
    """Each Python step of a task has a worker of its own, which stays; characters of which a part is removed go."""
    same = "é" * 60
    docs = spark.createDataFrame([(1, same), (2, "xĩ" + same), (3, "xé" + same + "é end")], "doc_id long, text string")
    out = dict(corpus_pipeline.STAGES)["substrings"](spark, docs, "")
    assert {r.doc_id: r.text for r in out.collect()} == {1: "é", 2: "x", 3: "x end"}
    assert out._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 1
