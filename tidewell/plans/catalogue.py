"""All registered queries over the catalogue operators, with their SQL."""

from __future__ import annotations

from tidewell.plans import etl, evaluation, quality, records, retrieval, seekers

MODULES = (etl, retrieval, evaluation, quality, records, seekers)
QUERIES = {name: plan for m in MODULES for name, plan in m.REGISTRY.queries.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.REGISTRY.oracles.items()}
