"""All queries for the operators of the survey."""

from __future__ import annotations

from lavra.plans import audit, learning, relational, scoring, telemetry, windows

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _module in (relational, audit, telemetry, windows, scoring, learning):
    QUERIES |= _module.R.queries
    SQL |= _module.R.sql
