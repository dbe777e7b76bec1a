"""Operators of a training-data pipeline; each module is one operator.

Nothing outside this subpackage imports it.  ``queries.py`` registers one
query per operator, ``oracles.py`` the DuckDB twins where SQL can say them.
"""
