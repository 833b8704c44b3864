"""Relational builders and the core data-processing operators."""
