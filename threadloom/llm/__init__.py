"""Training-data operators: licence scans, token stores, quality, near-duplicates, media, counts, search, BPE, language, mixing.

Nothing outside this subpackage imports it; its queries are listed in :mod:`threadloom.llm.queries`.
"""
