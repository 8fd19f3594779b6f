"""Operators for preparing training text: filters, near duplicates, extraction, tokens.

Nothing outside this package imports it; ``queries.py`` holds its registered queries.
"""
