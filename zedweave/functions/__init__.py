"""Helpers for expressions and weights."""
