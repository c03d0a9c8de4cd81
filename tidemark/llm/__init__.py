"""Operators for building training corpora: the ten numbered operators and their queries.

Nothing outside this subpackage imports it.  Each module holds one operator; ``queries`` binds them to
the tables of the test data.
"""
