"""All queries of the library's own operators, and the SQL they are held against."""

from __future__ import annotations

from trackloom.plans import interval_queries, report_queries, scene_queries, source_queries, store_queries, track_queries
from trackloom.plans.common import Query

CATALOGS = [interval_queries.catalog, track_queries.catalog, scene_queries.catalog, store_queries.catalog, report_queries.catalog, source_queries.catalog]
QUERIES: dict[str, Query] = {k: v for c in CATALOGS for k, v in c.queries.items()}
ORACLE: dict[str, str] = {k: v for c in CATALOGS for k, v in c.oracle.items()}
FLAGSHIP = "score_report"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
