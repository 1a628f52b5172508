"""Operators for preparing large training corpora.

Nothing else in the library imports this subpackage; its queries are listed in
:mod:`mosaique.llm.queries`.
"""
