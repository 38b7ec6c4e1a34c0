"""Operators on relations."""
