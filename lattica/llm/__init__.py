"""Operators for large text corpora, and their queries.

Nothing outside this subpackage imports it.
"""
