"""Operators over change tables."""
