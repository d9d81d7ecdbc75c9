"""Operators for preparing language-model training data, one module each.

Every module offers a general operator on any DataFrame; ``queries.py`` applies them to the test tables.
"""
