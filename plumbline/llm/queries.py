"""Registered queries of the corpus operators and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from plumbline.llm import bpe, fingerprint, html, licenses, merkle, mixing, quality, sharding, simhash, substring, toxicity, trie, urls

QUERIES = {
    "op1_fingerprint": fingerprint.op1_fingerprint,
    "op2_substring_dedup": substring.op2_substring_dedup,
    "op3_bpe": bpe.op3_bpe,
    "op4_mixing": mixing.op4_mixing,
    "op5_licenses": licenses.op5_licenses,
    "op6_simhash": simhash.op6_simhash,
    "op7_html": html.op7_html,
    "op8_quality": quality.op8_quality,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_sharding": sharding.op10_sharding,
    "op11_merkle": merkle.op11_merkle,
    "op12_urls": urls.op12_urls,
    "op13_trie": trie.op13_trie,
}

ORACLES = {
    "op4_mixing": mixing.OP4_SQL,
    "op5_licenses": licenses.OP5_SQL,
    "op10_sharding": sharding.OP10_SQL,
    "op11_merkle": merkle.OP11_SQL,
    "op13_trie": trie.OP13_SQL,
}
