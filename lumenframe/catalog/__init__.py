"""All registered queries; importing this package fills the registry."""

from lumenframe.catalog import images, models, series, stats, tables, text  # noqa: F401
from lumenframe.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
