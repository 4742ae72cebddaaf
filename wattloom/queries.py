"""The registered queries of the demand-series library and their SQL."""

from __future__ import annotations

from wattloom.plans import feature_queries, forecast_queries, measure_queries

_PARTS = [feature_queries.R, measure_queries.R, forecast_queries.R]
QUERIES: dict = {k: v for r in _PARTS for k, v in r.queries.items()}
SQL: dict = {k: v for r in _PARTS for k, v in r.sql.items()}
FLAGSHIP = "features_train"
