"""Operators for preparing training text at scale.

One module per operator; ``registry`` holds the queries and their SQL.  Nothing
outside this subpackage imports it except the repository's entry points.
"""
