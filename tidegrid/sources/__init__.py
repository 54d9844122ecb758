"""Readers for the tables that queries run on."""

from tidegrid.sources.tables import TABLES, table

__all__ = ["TABLES", "table"]
