"""Operators for preparing language-model training corpora.

Nothing outside this package imports it. Each module holds one operator; `queries` registers the thin
queries over the synthetic tables.
"""
