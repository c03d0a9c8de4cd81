"""All queries over the test tables, and the SQL that they are compared with."""

from tidemark.queries import documents, features, market, scoring  # noqa: F401
from tidemark.queries.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
