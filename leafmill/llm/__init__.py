"""Operators for preparing language-model training data.

Nothing outside this package imports it.  Each module holds one operator with a
general interface; ``queries`` applies them to the synthetic tables.
"""
