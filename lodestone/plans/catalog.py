"""All registered queries; importing the catalogues fills the registry."""

from lodestone.plans import catalog_graph, catalog_metrics, catalog_sources, catalog_store, catalog_stream, catalog_text  # noqa: F401
from lodestone.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
