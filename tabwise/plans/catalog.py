"""All registered queries."""

from tabwise.plans import (  # noqa: F401
    catalog_ask, catalog_claims, catalog_clean, catalog_io, catalog_models, catalog_profile, catalog_stats,
)
from tabwise.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
