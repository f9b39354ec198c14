"""All registered street queries and their SQL."""

from __future__ import annotations

from blockweave.plans import catalog, city, oracle, town, town_oracle, views, views_oracle

QUERIES = catalog.QUERIES | city.QUERIES | views.QUERIES | town.QUERIES
ORACLE_SQL = oracle.ORACLE_SQL | views_oracle.VIEWS_SQL | town_oracle.TOWN_SQL
