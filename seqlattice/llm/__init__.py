"""Operators for preparing training text: deduplication, extraction, filtering, tokenisation.

Nothing outside this subpackage imports it.  ``queries`` has one thin query for each operator.
"""
