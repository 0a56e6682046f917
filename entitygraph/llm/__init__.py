"""Corpus operators for training-data pipelines.

Nothing outside this subpackage imports it: it can be deleted without any
effect on the rest of the library.  Each operator has a module of its own with
a general interface; ``registry`` holds the thin queries and their SQL.
"""
