"""All queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from skein.plans import corpus, engagement, features, governance, retrieval, streams  # noqa: F401  each registers its queries
from skein.plans.base import ORACLES, QUERIES  # noqa: F401
