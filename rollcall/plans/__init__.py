"""Named queries, grouped by area."""

from importlib import import_module

AREAS = (
    "rollups", "playtimes", "ratings", "boards", "activities", "histories", "states", "answers", "stored",
)


def load():
    """(queries, oracles) of all areas."""
    from rollcall.plans.registry import ORACLES, QUERIES

    for area in AREAS:
        import_module(f"rollcall.plans.{area}")
    return QUERIES, ORACLES
