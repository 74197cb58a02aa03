"""Operators over pages and corpora."""
