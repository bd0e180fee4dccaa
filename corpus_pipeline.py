"""The corpus pipeline: rules, near-duplicates, repeated strings, mixing, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it to the cluster's shared folder and
reads it again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from paleoframe.llm import common, mixing, quality_rules, sentencepiece, simhash, suffix_dedup

STAGES = [
    ("quality_rules", quality_rules.stage_quality),
    ("simhash", simhash.stage_simhash),
    ("substrings", suffix_dedup.stage_substrings),
    ("mixing", mixing.stage_mix),
    ("pieces", sentencepiece.stage_pieces),
]
#: Fingerprints, suffix arrays and piece scores have no SQL; tests compare the pipeline with a brute-force one.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
