"""Relational and sequential operators over evidence tables."""
