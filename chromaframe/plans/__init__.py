"""Fixture views and the named queries."""

import importlib
import pkgutil


def load_all() -> None:
    """Import every query module, which registers its queries."""
    for info in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        if info.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{info.name}")
