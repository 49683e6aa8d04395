"""Operators for preparing training text: one module per operator.

Nothing outside this folder imports it.  ``queries`` holds the registered
queries and ``oracles`` their SQL.
"""
