"""The corpus operators' queries and the SQL that checks them."""

from __future__ import annotations

from . import bytebpe, crf, hilbert, jaccard, lexical, matroska, mixing, phrases, quotes, rules, simple8b, spans, templates
from .sql import ORACLES

QUERIES = {
    "op1_sentence_spans": spans.query,
    "op2_hilbert_neighbours": hilbert.query,
    "op3_rule_ensemble": rules.query,
    "op4_quotation_linking": quotes.query,
    "op5_matroska_media": matroska.query,
    "op6_license_templates": templates.query,
    "op7_byte_bpe": bytebpe.query,
    "op8_simple8b_ids": simple8b.query,
    "op9_jaccard_join": jaccard.query,
    "op10_source_mixing": mixing.query,
    "op11_language_crf": crf.query,
    "op12_phrase_mining": phrases.query,
    "op13_ranked_search": lexical.query,
}
__all__ = ["ORACLES", "QUERIES"]
