"""Operators for building training corpora: deduplication, scoring, mixing, packing, sharding.

Nothing else in the library imports this subpackage. ``queries`` registers one query for
each operator.
"""
