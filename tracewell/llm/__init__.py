"""Operators for preparing training corpora, one module each.

Nothing else in the library imports this subpackage. ``registry`` holds the
queries and their DuckDB statements.
"""
