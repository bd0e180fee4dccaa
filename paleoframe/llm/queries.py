"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat, embedding_dedup, importance, langid, mixing, quality_model, quality_rules, repair, sentencepiece, simhash, suffix_dedup, token_counts, warc

QUERIES = {"op2_suffix_dedup": suffix_dedup.op2_suffix_dedup, "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup, "op6_simhash": simhash.op6_simhash, "op8_quality_classifier": quality_model.op8_quality_classifier, "op3_language_id": langid.op3_language_id, "op4_sentencepiece": sentencepiece.op4_sentencepiece, "op7_mixing": mixing.op7_mixing, "op1_warc": warc.op1_warc, "op5_chat_format": chat.op5_chat_format, "op10_quality_rules": quality_rules.op10_quality_rules, "op11_repair": repair.op11_repair, "op12_importance": importance.op12_importance, "op13_token_counts": token_counts.op13_token_counts}
ORACLE_SQL = {"op9_embedding_dedup": embedding_dedup.OP9_SQL, "op7_mixing": mixing.OP7_SQL, "op1_warc": warc.OP1_SQL, "op5_chat_format": chat.OP5_SQL, "op10_quality_rules": quality_rules.OP10_SQL, "op11_repair": repair.OP11_SQL, "op12_importance": importance.OP12_SQL}
