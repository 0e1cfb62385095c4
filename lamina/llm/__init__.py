"""Operators for preparing training text: fingerprints, chat formatting, tokenising, search, joins, packing, extraction, scoring.

Nothing outside this subpackage imports it; ``registry`` lists its queries and their SQL.
"""
