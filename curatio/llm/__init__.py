"""Operators for preparing training text: the ten dealt operators and their queries.

Nothing outside this subpackage imports it.
"""
