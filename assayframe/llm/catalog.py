"""Registered queries of this subpackage and their SQL checks."""

from __future__ import annotations

from assayframe.llm import q_corpus, q_lattice, q_licenses, q_lm, q_passages, q_rules, q_search, q_simhash, q_tokens, q_whitening, q_winnowing

_MODULES = (q_corpus, q_lattice, q_licenses, q_lm, q_passages, q_rules, q_search, q_simhash, q_tokens, q_whitening, q_winnowing)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in getattr(m, "ORACLES", {}).items()}
