"""Registered queries: importing this package fills the catalog."""

from lumenweft.plans import cohort_queries, latent_queries, series_queries  # noqa: F401
from lumenweft.plans.catalog import oracles as all_oracles
from lumenweft.plans.catalog import queries as all_queries

__all__ = ["all_oracles", "all_queries"]
