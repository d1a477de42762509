"""Operators for building language-model training corpora.

Nothing else in the package imports this subpackage; see ``queries`` for the
registered ``opN_<name>`` queries.
"""
