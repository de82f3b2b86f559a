"""Every operator as a query over the standard tables, with its SQL twin.

``registry()`` gives name -> (query, sql or None).
"""

from __future__ import annotations

from importlib import import_module

MODULES = ("search", "evaluation", "sequences", "validation", "inventory", "texts",
           "calibration", "streams")


def registry() -> dict:
    found = {}
    for name in MODULES:
        for key, pair in import_module(f"{__name__}.{name}").QUERIES.items():
            if key in found:
                raise ValueError(f"query registered twice: {key}")
            found[key] = pair
    return found
