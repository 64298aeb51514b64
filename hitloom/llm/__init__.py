"""Operators of a training-data pipeline.

Each module holds one operator with its own general interface; ``queries`` derives the
registered results from them.  Nothing else in the library imports this subpackage.
"""
