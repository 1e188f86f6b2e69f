"""Operators for preparing text for language-model training.

Nothing outside this folder imports it.  ``registry`` names the queries.
"""
