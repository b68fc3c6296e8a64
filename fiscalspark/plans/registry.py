"""All queries of the core and their SQL."""

from __future__ import annotations

from fiscalspark.plans import alerts, anchors, catalog, checks, data_problems, decisions, metrics, resolve, views

FLAGSHIP = "m01_grado_seccion"
_MODULES = (metrics, views, alerts, checks, catalog, resolve, anchors, decisions, data_problems)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
