"""Operators for preparing training data (documents, pages, embeddings).

Each module holds one operator; ``queries.py`` registers the thin
``opN_<name>`` queries over the given tables.  Nothing outside this
subpackage imports it.
"""
