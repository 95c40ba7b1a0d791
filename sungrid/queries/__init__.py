"""All registered queries. Importing a module registers its queries."""

from . import columns, grids, ingest, learning, statistics
from .base import REGISTRY

__all__ = ["REGISTRY", "columns", "grids", "ingest", "learning", "statistics"]
