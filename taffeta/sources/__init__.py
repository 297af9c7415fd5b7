"""Readers and writers."""

from taffeta.sources.tables import TABLES, load_table  # noqa: F401
