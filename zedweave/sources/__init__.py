"""Inputs of relations: buffered updates, whole frames, change feeds."""
