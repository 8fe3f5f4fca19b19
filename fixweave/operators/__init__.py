"""Relational, sequence and data-repair operators."""
