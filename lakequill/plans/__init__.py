"""All named queries."""

from lakequill.plans import documents, indexes, learned, paged, relational, retrieval, rows, stateful
from lakequill.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "documents", "indexes", "learned", "paged", "relational", "retrieval", "rows", "stateful"]
