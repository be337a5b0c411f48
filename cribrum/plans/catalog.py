"""All registered queries of the library and their SQL."""

from __future__ import annotations

from . import cleaning, filtering, io, metrics, modelling, ranking, routing, similarity, spatial, streams  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
