"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Each ``opN_*`` module
holds one operator with its own general interface, and the thin query that
applies it to its whole table; ``registry`` lists the queries and their SQL.
"""
