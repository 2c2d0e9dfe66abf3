"""Registered queries and the SQL that states the same result independently."""

from loadlens.plans.catalog.base import REGISTRY, Query, query  # noqa: F401


def load_all() -> dict[str, "Query"]:
    """Import every query module and return the registry."""
    from loadlens.plans.catalog import (  # noqa: F401
        core, cleaning, bills, climate, profiling, modelling, delivery,
        exchange,
    )

    return REGISTRY
