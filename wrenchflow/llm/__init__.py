"""Operators for building training corpora (documents, labels, benchmark tables).

Nothing outside this subpackage imports it; ``queries.py`` holds the registered queries.
"""
