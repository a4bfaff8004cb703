"""Operators for building training corpora.

Nothing outside this subpackage imports it; it may be removed without harming the rest.
``registry.queries()`` and ``registry.oracle_sql()`` list its queries.
"""
