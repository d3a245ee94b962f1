"""All corpus queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import archives, chat, decontaminate, dialogue, fingerprints, main_text, manifest, mixing, neardup, packing, secrets, token_files, toxicity

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (secrets, fingerprints, token_files, archives, main_text, toxicity, neardup, packing, decontaminate, chat, manifest, dialogue, mixing):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
