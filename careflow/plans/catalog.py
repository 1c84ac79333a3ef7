"""All registered queries."""

from careflow.plans import queries_bins, queries_clean, queries_ensemble, queries_extract, queries_io, queries_model, queries_report  # noqa: F401
from careflow.plans.registry import COVERS, QUERIES, SQL

__all__ = ["COVERS", "QUERIES", "SQL"]
