"""Operators a training-data pipeline needs, on whole text tables.

One module per operator; ``queries`` registers them.  Nothing else in the library
imports this package.
"""
