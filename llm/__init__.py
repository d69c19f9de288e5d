"""Training-data operators: deduplication, archives, search, scoring, packing and encoding.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries when it is present.
"""
