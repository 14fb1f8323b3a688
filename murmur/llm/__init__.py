"""Operators for building training corpora out of document tables.

Nothing outside this package imports it; ``__spark_entry__.py`` registers its
queries only when the package is present.
"""
