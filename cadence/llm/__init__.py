"""Operators for building large training corpora, one module each.

Nothing else in the library imports this subpackage.
"""
