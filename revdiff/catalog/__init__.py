"""Every operator wired to the snapshots over the given tables."""

from revdiff.catalog import headers, items, notices, pages, tables, texts  # noqa: F401
from revdiff.catalog.base import QUERIES  # noqa: F401
