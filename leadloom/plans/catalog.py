"""The core's queries and their SQL, gathered from the modules by area."""

from __future__ import annotations

from leadloom.plans import audits, filters, packed, records, scalars

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (packed, scalars, filters, records, audits):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
