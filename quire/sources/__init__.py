"""Scans and sinks."""
from quire.sources.tables import TABLES, read_table, load_tables  # noqa: F401
