"""Training-data operators: sharding, joins on shingles, toxicity, packing, suffix-array
dedup, chat rendering, byte-level BPE, embedding dedup, quality rules and licence scans.

Nothing else in the library imports this subpackage. Its queries are listed in
:mod:`presswire.llm.queries`.
"""
