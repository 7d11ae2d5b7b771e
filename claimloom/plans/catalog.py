"""All queries of the library and their DuckDB twins, gathered from the modules beside this one."""

from __future__ import annotations

from claimloom.plans import articles, claims, flows, graph, linking, ontology, search

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (search, articles, claims, linking, graph, ontology, flows):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
