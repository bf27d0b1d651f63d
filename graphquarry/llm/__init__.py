"""Training-data operators: tokenisers, media columns, quality, deduplication, packing.

Nothing outside this folder imports it; `__spark_entry__` adds its queries only if it is there.
"""
