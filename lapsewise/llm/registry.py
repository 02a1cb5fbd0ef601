"""Queries of this subpackage, by name, and their SQL where it can be stated."""

from __future__ import annotations

from lapsewise.llm import brown, chat, fim, langid, line_dedup, merkle, minhash, packing, pieces, pii, quality, suffix_dedup, vector_graph

QUERIES = {
    "op1_quality_rules": quality.query,
    "op2_language_id": langid.query,
    "op3_pii": pii.query,
    "op4_brown_lm": brown.query,
    "op5_chat_format": chat.query,
    "op6_pieces": pieces.query,
    "op7_packing": packing.query,
    "op8_suffix_dedup": suffix_dedup.query,
    "op9_vector_graph": vector_graph.query,
    "op10_minhash": minhash.query,
    "op11_line_dedup": line_dedup.query,
    "op12_merkle_manifest": merkle.query,
    "op13_fill_in_middle": fim.query,
}

ORACLE_SQL = {
    "op5_chat_format": chat.SQL,
    "op8_suffix_dedup": suffix_dedup.SQL,
    "op9_vector_graph": vector_graph.SQL,
    "op10_minhash": minhash.SQL,
    "op11_line_dedup": line_dedup.SQL,
    "op12_merkle_manifest": merkle.SQL,
    "op13_fill_in_middle": fim.SQL,
}
