"""Relational and page-level operators."""
