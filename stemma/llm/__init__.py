"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface and, in ``queries.py``, one query that
applies it to a whole supplied table.
"""
