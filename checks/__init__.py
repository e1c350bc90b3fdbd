"""Registered queries and their SQL twins, by area."""

import importlib
import pkgutil


def all_checks() -> dict:
    from . import base

    for mod in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{mod}")
    return dict(base.REGISTRY)
