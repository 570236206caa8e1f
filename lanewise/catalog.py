"""Every registered query with its SQL."""

from __future__ import annotations

from lanewise.plans import cascade, curation, decisions, documents, grids, identity, layouts, linescan, loading, registered, relays, repair, reports, results

_PLANS = (results, loading, curation, documents, relays, identity, grids, reports, decisions, registered, layouts, repair, cascade, linescan)
QUERIES: dict = {k: v for plan in _PLANS for k, v in plan.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for plan in _PLANS for k, v in plan.ORACLES.items()}
