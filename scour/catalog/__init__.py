"""Every operator as a named query over the shared tables, with its plain-SQL counterpart."""

from scour.catalog.base import QUERIES, Query, Tables
from scour.catalog import changes, checks, cleaning, hard, series, sources, spelling, texts  # noqa: F401

__all__ = ["QUERIES", "Query", "Tables"]
