"""Operators of a training-data pipeline (tokenising, dedup, filters, formats).

Nothing else in the library imports this subpackage.
"""
