"""Operators for preparing language-model training text, and a pipeline's parts.

Nothing else in the library imports this subpackage. ``queries`` registers one query per operator.
"""
