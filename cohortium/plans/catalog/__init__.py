"""Registered queries with their SQL twins."""

from importlib import import_module

from .registry import ORACLES, QUERIES

for _name in ("scalars", "tables", "quality", "fills", "features", "training", "explaining", "scores", "io"):
    import_module(f"{__name__}.{_name}")

__all__ = ["QUERIES", "ORACLES"]
