"""Operators for building training corpora: one module each, plus the queries that apply them."""
