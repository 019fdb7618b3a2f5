"""Runnable queries over the test tables, one or more per operator."""


def load():
    """Import every query module and return the register."""
    from importlib import import_module

    for name in ("sources", "rows", "relations", "measures", "profiles", "ordered", "preparing", "splits", "auditing", "planning", "statistics", "scoring"):
        import_module(f"featloom.catalogue.{name}")
    return import_module("featloom.catalogue.base")
