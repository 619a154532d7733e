"""All registered queries."""

from lossbook.plans import catalog_fitted, catalog_models, catalog_reports, catalog_rows  # noqa: F401
from lossbook.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
