"""Every operator as a query on the driver's tables, with its check SQL."""

from . import catalog_batches, catalog_ingest, catalog_mail, catalog_matching, catalog_pages, catalog_run, catalog_sinks, catalog_sources  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
