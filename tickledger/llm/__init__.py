"""Operators for building training corpora, with their queries (``queries.QUERIES``, ``queries.CHECKS``).

Nothing outside this package imports it.
"""
