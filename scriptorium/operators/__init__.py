"""Relational operators: joins, windows, votes, sampling, statistics."""
