"""Relational algebra on views."""
