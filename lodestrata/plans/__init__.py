"""Registered queries of the library: name -> query, and the SQL of those that SQL can express."""

from __future__ import annotations

from lodestrata.plans import audits, clouds, draws, files, fits, formations, inference, networks, panels, portfolios

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _m in (panels, networks, clouds, portfolios, inference, files, fits, draws, audits, formations):
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= _m.ORACLE_SQL

FLAGSHIP = clouds.energy_v
