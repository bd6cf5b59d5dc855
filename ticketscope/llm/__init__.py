"""Operators for preparing training data: near copies, page text, labels, tokens, search."""
