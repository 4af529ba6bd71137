"""Operators for preparing training data.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; :mod:`tessella.llm.entries` holds the thin
``opN_<name>`` queries, with their production parameters and SQL.
"""
