"""Operators for preparing language-model training data, all running as Spark jobs.

Nothing else in the library imports this subpackage.
"""
