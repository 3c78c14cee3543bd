"""Operators for preparing training text: ten of them, each on a table of doc_id and text."""
