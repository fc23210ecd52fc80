"""Training-data operators: dedup, scans, mixing, packing and quality, as Spark jobs.

Nothing else in the library imports this subpackage.
"""
