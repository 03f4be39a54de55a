"""Registry of the grid engine's queries and their DuckDB twins."""

from __future__ import annotations

from gridloom.plans import evaluation, freespace, mapping, sequences

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (mapping, freespace, sequences, evaluation):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
