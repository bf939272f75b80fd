"""Strict JSON, pointers and column expressions."""
