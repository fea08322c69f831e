"""Expressions and small algorithms that operators share."""
