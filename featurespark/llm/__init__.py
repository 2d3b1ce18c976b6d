"""Operators for preparing training text: personal data, duplicates at document,
line, passage and byte level, language, language-model scores, subword pieces
and benchmark overlap.

Nothing outside this package imports it. Every operator takes a DataFrame of
documents (``doc_id`` bigint, ``text`` string by default; other columns are
ignored or passed through) and returns a DataFrame.
"""
