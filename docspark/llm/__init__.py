"""Training-data operators: quality, dedup, mixing, scanning and tokenization.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` registers its
queries when it is present.
"""
