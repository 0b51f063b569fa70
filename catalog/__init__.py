"""Every registered query with the SQL that checks it."""

from catalog import cleaning, features, layout, quality, reports, serving, sources  # noqa: F401
from catalog.base import CATALOG

__all__ = ["CATALOG"]
