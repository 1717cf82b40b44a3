"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it; ``queries`` registers its queries and SQL.
"""
