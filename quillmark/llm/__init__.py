"""Operators for preparing language-model training data.

Nothing else in the package imports this folder; ``__spark_entry__`` adds its
queries only when it can be imported.
"""
