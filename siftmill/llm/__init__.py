"""Operators for preparing training data: selection, near-duplicates, code pairs, consolidation, secrets, tokens, mixing, repair."""
