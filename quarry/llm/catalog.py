"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from quarry.llm import (bpe, decontaminate, language_id, lexical_search, license_scan, ngram_join, prefix_trie,
                        quality_ranker, quality_rules, secret_scan, token_counts, token_files, toxicity)

MODULES = (language_id, secret_scan, quality_rules, bpe, license_scan, toxicity, decontaminate, ngram_join, quality_ranker, token_counts,
           prefix_trie, token_files, lexical_search)

QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
