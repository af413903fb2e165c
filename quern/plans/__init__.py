"""Query plans over the driver's tables."""

from quern.plans import analytics, changes, dashboard, fuzzy, indexes, quality, record_queries, relations, retrieval, sources, statutes, texts, validation  # noqa: F401  (they register their queries)
from quern.plans.registry import QUERIES as ALL_QUERIES
from quern.plans.registry import SQL as ALL_SQL
