"""Training-data operators: scoring, extraction, deduplication, mixing, formatting.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries when it is there.
"""
