"""Operators over training-data corpora, one module for each, and their queries.

Nothing else in the library imports this subpackage.
"""
