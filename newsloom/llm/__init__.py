"""Operators for corpora of training documents, their queries and their SQL."""
