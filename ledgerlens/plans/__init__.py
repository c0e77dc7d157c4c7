"""Registered queries over the test tables, each with its SQL where SQL can express it."""

from importlib import import_module
from pkgutil import iter_modules


def load_all():
    """Import every query module and return (queries, SQL)."""
    for module in iter_modules(__path__):
        if module.name.startswith("q_"):
            import_module(f"{__name__}.{module.name}")
    from ledgerlens.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
