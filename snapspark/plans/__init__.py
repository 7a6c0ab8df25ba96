"""Registered queries by family."""

from importlib import import_module

FAMILIES = ("browse", "joins", "aggregates", "quality", "publication", "audits", "media", "exports", "layout", "search", "jobs", "streams")


def load_all() -> None:
    from importlib.util import find_spec

    for family in FAMILIES:
        if find_spec(f"{__name__}.{family}") is not None:
            import_module(f"{__name__}.{family}")
