"""Operators of a training-data pipeline over tables of documents and pages.

Nothing else in the library imports this subpackage.  Each module holds one operator with its
general interface, and the thin query that applies it to a whole table.
"""
