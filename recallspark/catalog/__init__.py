"""Importing this package registers every query."""

from . import ingest, memory, reports, search, streams  # noqa: F401
