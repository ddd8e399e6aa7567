"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import byte_bpe, fill_in_middle, language_id, merkle, nearest_quality, ngram_join, packing, pii, quality_lines, secret_ledger, suffix_dedup, toxicity, transport_stream

QUERIES = {
    "op1_transport_stream": transport_stream.query,
    "op2_toxicity": toxicity.query,
    "op3_best_fit_packing": packing.query,
    "op4_suffix_dedup": suffix_dedup.query,
    "op5_language_id": language_id.query,
    "op6_pii": pii.query,
    "op7_secret_ledger": secret_ledger.query,
    "op8_quality_lines": quality_lines.query,
    "op9_byte_bpe": byte_bpe.query,
    "op10_ngram_join": ngram_join.query,
    "op11_fill_in_middle": fill_in_middle.query,
    "op12_nearest_quality": nearest_quality.query,
    "op13_merkle": merkle.query,
}

ORACLE: dict[str, str] = {
    "op7_secret_ledger": secret_ledger.SQL,
    "op8_quality_lines": quality_lines.SQL,
    "op10_ngram_join": ngram_join.SQL,
    "op11_fill_in_middle": fill_in_middle.SQL,
    "op13_merkle": merkle.SQL,
}
