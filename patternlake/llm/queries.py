"""Queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, forest, interaction, language, near, packing, pii, quality, repair, repeats, secrets, token_counts

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_suffix_dedup": repeats.op2_suffix_dedup,
    "op3_chat_format": chat.op3_chat_format,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_pii": pii.op5_pii,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_ann_forest": forest.op8_ann_forest,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_near_dedup": near.op10_near_dedup,
    "op11_language_id": language.op11_language_id,
    "op12_turn_repair": repair.op12_turn_repair,
    "op13_filter_audit": interaction.op13_filter_audit,
}
ORACLES = {
    "op1_quality_rules": quality.OP1_SQL,
    "op2_suffix_dedup": repeats.OP2_SQL,
    "op3_chat_format": chat.OP3_SQL,
    "op10_near_dedup": near.OP10_SQL,
    "op13_filter_audit": interaction.OP13_SQL,
}
