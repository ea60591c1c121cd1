"""All registered queries of the library proper."""

from salesflow.plans import analytics, feed_queries, mechanism_queries, rule_queries, source_queries, star_queries  # noqa: F401  they register their queries
from salesflow.plans.domain import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
