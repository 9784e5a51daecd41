"""All queries by name; importing this module registers every module's."""

from matchloom.plans import aggregates, composite, deep, files, filters, ingest, joins, models, strength, surfaces, windows  # noqa: F401
from matchloom.plans.base import ORACLES, QUERIES  # noqa: F401
