"""Every registered query with its comparison SQL."""

import importlib

from .registry import ORACLES, QUERIES

for _module in ("tables", "audit", "prepare", "explore", "chart", "board", "ask", "log"):
    try:
        importlib.import_module(f".{_module}", __name__)
    except ModuleNotFoundError as e:
        if e.name != f"{__name__}.{_module}":
            raise

__all__ = ["ORACLES", "QUERIES"]
