"""All registered queries."""

from chartloom.plans import check_queries, cohort_queries, record_queries, table_queries, text_queries  # noqa: F401
from chartloom.plans.registry import CHECKS, QUERIES

__all__ = ["QUERIES", "CHECKS"]
