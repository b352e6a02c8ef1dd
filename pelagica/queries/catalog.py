"""All queries; importing the modules registers them."""

from __future__ import annotations

from . import calibrations, deployed, files, geometry, records, sequences, streams  # noqa: F401
from .registry import checks, queries

__all__ = ["checks", "queries"]
