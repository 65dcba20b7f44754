"""Operators of the site screening library."""
