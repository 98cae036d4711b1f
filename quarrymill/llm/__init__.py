"""Operators that prepare training text from a document collection.

Nothing outside this subpackage imports it.  ``registry`` holds the queries
and their SQL; the entry module adds them when the subpackage is present.
"""
