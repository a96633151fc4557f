"""All named queries of the engine and the DuckDB text of each."""

from __future__ import annotations

from . import batched, dataframes, endpoints, fitted, judged, linkage, matches, modelling, networks, ranked, texts

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _part in (texts, dataframes, matches, modelling, networks, endpoints, linkage, judged, batched, networks):
    QUERIES |= _part.QUERIES
    ORACLE |= _part.ORACLE
QUERIES |= ranked.QUERIES  # the SQL of texts, in other plans
QUERIES |= fitted.QUERIES  # fitted models: no SQL
