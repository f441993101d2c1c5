"""Training-data operators: text scoring, deduplication, extraction, encoding and packing.

Nothing else in the library imports this subpackage; its queries are listed in
``pairloom.llm.catalog``.
"""
