"""Logical plans of standing relations and the two ways to evaluate them."""
