"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from evidra.llm import op10_quality, op11_toxicity, op12_repair, op13_divergence, op1_embedding, op2_decontaminate, op3_shards, op4_tokens, op5_pst, op6_simhash, op7_chat, op8_pieces, op9_pii

QUERIES = {
    "op1_embedding_neardup": op1_embedding.op1_embedding_neardup,
    "op2_decontaminate": op2_decontaminate.op2_decontaminate,
    "op3_kd_shards": op3_shards.op3_kd_shards,
    "op4_token_ids": op4_tokens.op4_token_ids,
    "op5_pst_score": op5_pst.op5_pst_score,
    "op6_simhash_neardup": op6_simhash.op6_simhash_neardup,
    "op7_chat_format": op7_chat.op7_chat_format,
    "op8_pieces": op8_pieces.op8_pieces,
    "op9_pii": op9_pii.op9_pii,
    "op10_quality": op10_quality.op10_quality,
    "op11_toxicity": op11_toxicity.op11_toxicity,
    "op12_repair": op12_repair.op12_repair,
    "op13_divergence": op13_divergence.op13_divergence,
}
ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": op2_decontaminate.SQL,
    "op7_chat_format": op7_chat.SQL,
    "op12_repair": op12_repair.SQL,
    "op13_divergence": op13_divergence.SQL,
}
