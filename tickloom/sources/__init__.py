"""Scans and sinks."""

from .tables import table  # noqa: F401
