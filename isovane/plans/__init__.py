"""Iterative plans (fixpoints) and plan-level helpers."""
