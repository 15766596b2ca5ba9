"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, filter_audit, hash_forest, language_model, mixing, ngram_join, prefix_trie, quality_classifier, quality_rules, secret_scan, sharding, token_store, toxicity

QUERIES = {
    "op1_quality_classifier": quality_classifier.query,
    "op2_ngram_join": ngram_join.query,
    "op3_sharding": sharding.query,
    "op4_token_store": token_store.query,
    "op5_toxicity": toxicity.query,
    "op6_hash_forest": hash_forest.query,
    "op7_byte_bpe": bpe.query,
    "op8_mixing": mixing.query,
    "op9_language_model": language_model.query,
    "op10_quality_rules": quality_rules.query,
    "op11_filter_audit": filter_audit.query,
    "op12_prefix_trie": prefix_trie.query,
    "op13_secret_scan": secret_scan.query,
}

SQL = {
    "op3_sharding": sharding.SQL,
    "op8_mixing": mixing.SQL,
    "op10_quality_rules": quality_rules.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
}
