"""Operators that turn a document collection into training data.

Nothing else in the package imports this subpackage; it can be removed whole.
"""
