"""Operators that prepare large text collections for language-model training.

Nothing outside this package imports it; ``queries.py`` registers one query for each operator.
"""
