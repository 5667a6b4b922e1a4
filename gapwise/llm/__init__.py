"""Operators for preparing language-model training data, each with its own method.

Nothing else in the library imports this subpackage.  ``queries.QUERIES`` and
``queries.ORACLES`` hold the registered queries and their SQL.
"""
