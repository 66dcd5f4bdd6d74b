"""Operators for preparing training text and searching embeddings at scale.

Nothing else in the library imports this subpackage. `queries` registers one query per operator.
"""
