"""Operators that prepare text for training language models.

Nothing outside this subpackage imports it; the entry module adds its queries
only where it can be imported.
"""
