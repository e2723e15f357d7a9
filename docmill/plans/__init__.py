"""Queries that compose the operators, and their SQL."""
