"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import op1_quality, op2_mixing, op3_sharding, op4_language, op5_secrets, op6_simhash, op7_bpe, op8_embeddings, op9_warc, op10_token_files, op11_pitman_yor, op12_prefix_trie, op13_hard_negatives

QUERIES = {
    "op1_quality": op1_quality.op1_quality,
    "op2_mixing": op2_mixing.op2_mixing,
    "op3_sharding": op3_sharding.op3_sharding,
    "op4_language": op4_language.op4_language,
    "op5_secrets": op5_secrets.op5_secrets,
    "op6_simhash": op6_simhash.op6_simhash,
    "op7_bpe": op7_bpe.op7_bpe,
    "op8_embeddings": op8_embeddings.op8_embeddings,
    "op9_warc": op9_warc.op9_warc,
    "op10_token_files": op10_token_files.op10_token_files,
    "op11_pitman_yor": op11_pitman_yor.op11_pitman_yor,
    "op12_prefix_trie": op12_prefix_trie.op12_prefix_trie,
    "op13_hard_negatives": op13_hard_negatives.op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op1_quality": op1_quality.ORACLE,
    "op2_mixing": op2_mixing.ORACLE,
    "op3_sharding": op3_sharding.ORACLE,
    "op12_prefix_trie": op12_prefix_trie.ORACLE,
    "op13_hard_negatives": op13_hard_negatives.ORACLE,
}
