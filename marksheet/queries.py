"""Registered queries over the driver tables and their SQL."""

from __future__ import annotations

from .registered import cleaning, exam, significance, tables

_MODULES = (exam, cleaning, tables, significance)
QUERIES: dict = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES: dict = {k: q for m in _MODULES for k, q in m.ORACLES.items()}
